"""Column-expression helpers used by the operators."""

from orderlens.functions.dates import month_index, month_label, parse_dmy
from orderlens.functions.numeric import (
    clip, guarded_percent, percent, ratio, rint_k, sum0,
)
from orderlens.functions.text import (
    allowed_file, basename, brand_label, day_label, ellipsis, extension,
    glob_to_regex, ordinal, secure_filename, sku_class, warehouse_label,
)

__all__ = [
    "allowed_file", "basename", "brand_label", "clip", "day_label", "ellipsis",
    "extension", "glob_to_regex", "guarded_percent", "month_index", "month_label",
    "ordinal", "parse_dmy", "percent", "ratio", "rint_k", "secure_filename",
    "sku_class", "sum0", "warehouse_label",
]
