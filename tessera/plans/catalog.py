"""All registered queries: importing the plan modules fills the registry."""

from . import q_scorecard  # noqa: F401
from . import q_profile  # noqa: F401
from . import q_stats  # noqa: F401
from . import q_text  # noqa: F401
from . import q_ml  # noqa: F401
from . import q_stream  # noqa: F401
from . import q_neighbors  # noqa: F401
from . import q_models  # noqa: F401
from . import q_misc  # noqa: F401
from . import q_more_models  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
