from . import group_a, group_b, group_c, group_d, group_d2, group_e, group_i, group_k, group_l, group_r  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
