from fundflow.functions.dates import check_even_cycle, cycle_of, date_window, local_date  # noqa: F401
from fundflow.functions.labels import display_category, leaf_label, office_label  # noqa: F401
from fundflow.functions.money import (  # noqa: F401
    compact_dollars, full_dollars, nullif_zero, ratio, zero_if_null,
)
from fundflow.functions.text import (  # noqa: F401
    none_sentinel, pad_district, person_name, split_ws, strip_ws, title_case,
)
