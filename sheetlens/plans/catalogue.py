"""All registered queries of the reference's own operators; importing this registers them."""

from . import comparison, ensemble, jobs, nested, processing, relational, reports, review, sheets, signals, templates, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
