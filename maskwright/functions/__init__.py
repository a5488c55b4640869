"""Column-level helpers shared by the operators."""

from maskwright.functions.numeric import *  # noqa: F401,F403
