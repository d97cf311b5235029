"""Fixed schemas of the three tables, with defaults for values that a record lacks."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "map<string;string>": T.MapType(T.StringType(), T.StringType())}


def _struct(columns: str) -> T.StructType:
    """A schema from "name kind, ..."; Spark's own parser of such strings needs a running session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (c.split() for c in columns.split(", "))])


BUSINESS = _struct("business_id string, name string, city string, state string, latitude double, longitude double, review_count int, stars double, is_open int, photo_count double, categories string, attributes map<string;string>, hours map<string;string>")
PHOTO = _struct("photo_id string, business_id string, label string")
REVIEW = _struct("review_id string, business_id string, text string, stars double, date string, user_id string, useful int, funny int, cool int, sentiment_label string, sentiment_confidence double, prob_negative double, prob_neutral double, prob_positive double, sentiment_score_prob_diff double, sentiment_score_expected double, sentiment_score_logit double")

#: What an absent or null field becomes.
BUSINESS_DEFAULTS = {"review_count": 0, "stars": 0.0, "is_open": 1, "photo_count": 0.0, "categories": ""}
PHOTO_DEFAULTS = {"label": "unknown"}
REVIEW_DEFAULTS = {"text": "", "stars": 0.0, "user_id": "", "useful": 0, "funny": 0, "cool": 0, "sentiment_label": "neutral"} | {f.name: 0.0 for f in REVIEW if f.name.startswith(("sentiment_conf", "sentiment_score", "prob_"))}
REQUIRED = ("business_id", "name", "city", "state", "latitude", "longitude")

#: Ranges of values that a served row may have: (least, greatest).
RANGES = {"stars": (0, 5), "useful": (0, None), "funny": (0, None), "cool": (0, None), "prob_negative": (0, 1), "prob_neutral": (0, 1), "prob_positive": (0, 1)}
