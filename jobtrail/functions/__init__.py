"""Column-level helpers (F1-F16): pure ``pyspark.sql.Column`` algebra."""

from jobtrail.functions.text import (  # noqa: F401
    JS_WS_CLASS,
    capitalize_words,
    collapse_ws,
    cut,
    first_items,
    html_escape,
    leading_int,
    null_if_blank,
    trim_js,
)
from jobtrail.functions.urls import (  # noqa: F401
    canonical_url,
    is_absolute_url,
    url_host,
    url_origin,
    url_path,
    with_canonical_url,
)
