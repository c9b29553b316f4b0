"""All queries of this subpackage by name, and SQL where it can say the same."""

from . import attention_lm, bpe, html, langid, line_dedup, ngram_join, packing, pii, quality, topk

MODULES = (html, ngram_join, quality, pii, line_dedup, attention_lm, packing, langid, topk, bpe)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in getattr(m, "ORACLES", {}).items()}
