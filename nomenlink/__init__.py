"""Resolve species names to authority codes on Spark."""

from .functions.cleaning import clean_names, invert_comma, strip_redundant
from .operators.assemble import Resolved, assemble, sent_codes
from .operators.candidates import (
    combine_services,
    flag_ambiguous,
    prefer_exact_spelling,
    review_spelling,
    select_candidates,
    split_known_unknown,
    unchecked_codes,
)
from .operators.groups import keep_if_any
from .operators.policies import (
    decide_best,
    decide_itis,
    decide_worms,
    decide_worms_common,
    xwalk_aphia,
    xwalk_tsn,
)
from .plans.incremental import AnswerStore, resolve_incrementally
from .plans.resolve import resolve_names
from .plans.resumable import resolve_resumably
from .sources.authorities import Authorities
from .sources.names import with_row_id
from .sources.prepared import PreparedAuthorities
from .version import __version__

__all__ = [
    "AnswerStore", "Authorities", "PreparedAuthorities", "Resolved", "__version__", "assemble", "clean_names",
    "combine_services", "decide_best", "decide_itis", "decide_worms",
    "decide_worms_common", "flag_ambiguous", "invert_comma", "keep_if_any",
    "prefer_exact_spelling", "resolve_incrementally", "resolve_names", "resolve_resumably",
    "review_spelling", "select_candidates", "sent_codes", "split_known_unknown",
    "strip_redundant", "unchecked_codes", "with_row_id",
    "xwalk_aphia", "xwalk_tsn",
]
