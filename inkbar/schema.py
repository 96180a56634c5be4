"""Types shared by every operator: spans, raw scorer records, requests."""

from __future__ import annotations

from pyspark.sql import types as T

# The eight categories a span may carry.  Scorers may emit other
# names too, so the column itself is a plain string.
ACCOUNT_NUMBER = "account_number"
PRIVATE_ADDRESS = "private_address"
PRIVATE_DATE = "private_date"
PRIVATE_EMAIL = "private_email"
PRIVATE_PERSON = "private_person"
PRIVATE_PHONE = "private_phone"
PRIVATE_URL = "private_url"
SECRET = "secret"

ENTITIES = (
    ACCOUNT_NUMBER,
    PRIVATE_ADDRESS,
    PRIVATE_DATE,
    PRIVATE_EMAIL,
    PRIVATE_PERSON,
    PRIVATE_PHONE,
    PRIVATE_URL,
    SECRET,
)

# The score of a rule hit, the name of an unnamed category, the
# size limit of one text or file, and the separator inside a fingerprint.
RULE_SCORE = 0.95
UNKNOWN_ENTITY = "UNKNOWN"
MAX_TEXT_BYTES = 5 * 1024 * 1024
UNIT_SEPARATOR = "\x1f"

# Offsets are 0-based code points, half open, so that
# substring(text, start + 1, end - start) is always the span's text.
SPAN = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)
SPANS = T.ArrayType(SPAN)
SPANS_DDL = "array<struct<entity:string,text:string,start:int,end:int,score:double>>"

RAW_SPAN = T.StructType(
    [
        T.StructField("entity_group", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)
RAW_SPANS = T.ArrayType(RAW_SPAN)
RAW_SPANS_DDL = (
    "array<struct<entity_group:string,entity:string,score:double,start:int,end:int>>"
)

REQUEST = T.StructType(
    [
        T.StructField("req_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("min_score", T.DoubleType()),
        T.StructField("ru_postpass", T.BooleanType()),
        T.StructField("ru_postpass_strict", T.BooleanType()),
        T.StructField("placeholder", T.StringType()),
        T.StructField("mask_char", T.StringType()),
    ]
)
