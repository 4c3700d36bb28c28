"""All registered queries of this package."""

from . import ann, bpe, chat, collocations, decontaminate, hard_negatives, jaccard_join, katz, langid, line_dedup, passages, pii, quality  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
