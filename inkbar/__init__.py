"""Finding and redacting personal data and secrets in text columns."""

import sys

from pyspark import cloudpickle

from inkbar.functions.redact import highlight_html, redact, segment_text
from inkbar.functions.rules import make_rule
from inkbar.functions.scan import ru_postpass
from inkbar.functions.sql import register_sql_functions
from inkbar.operators.detect import detect_pii, detect_regex_only, pii_spans
from inkbar.operators.model import detect_batch, detect_one
from inkbar.operators.validate import Options, validate_requests
from inkbar.plans.job import redact_with_external_spans, run, serve_requests
from inkbar.schema import ENTITIES, SPAN, SPANS

# Python functions that run in workers travel by value, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ENTITIES",
    "Options",
    "SPAN",
    "SPANS",
    "detect_batch",
    "detect_one",
    "detect_pii",
    "detect_regex_only",
    "highlight_html",
    "make_rule",
    "pii_spans",
    "redact",
    "redact_with_external_spans",
    "register_sql_functions",
    "ru_postpass",
    "run",
    "segment_text",
    "serve_requests",
    "validate_requests",
]
