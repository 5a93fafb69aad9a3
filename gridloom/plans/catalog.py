"""Imports every module that registers queries."""

from gridloom.plans import q_catalog, q_files, q_grids, q_horizon, q_more, q_scalars, q_terrain, q_tiles, q_time  # noqa: F401

FLAGSHIP = "exp_flagship_where"
