"""The registered queries of search, columns, certification, evaluation and streams."""

from quillstone.plans import certificates, columns, profiles, streams  # noqa: F401
from quillstone.plans import registry as REGISTRY  # noqa: F401
