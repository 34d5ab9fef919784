from batchwright.functions.scalar import *  # noqa: F401,F403
from batchwright.functions.scalar import __all__  # noqa: F401
