"""Column functions: built-in expressions (JVM side) plus two Arrow helpers."""

from sparkeda.functions.text import *  # noqa: F401,F403
from sparkeda.functions.text import __all__  # noqa: F401
