from test_jaccard import brute as near_brute  # noqa: F401
from test_packing import check as packing_check  # noqa: F401
