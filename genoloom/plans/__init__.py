"""Named queries over the given tables."""
from .catalog import all_checks, all_queries  # noqa: F401
from . import q_core, q_groups, q_profiles, q_recovery, q_sources, q_tables, q_tiers  # noqa: F401
