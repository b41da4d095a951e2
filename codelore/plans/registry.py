"""All registered queries."""

from codelore.plans import evaluation, examples, features, sources, stats, text, trees, typelib, vocab  # noqa: F401
from codelore.plans.register import ORACLE_SQL, QUERIES  # noqa: F401
