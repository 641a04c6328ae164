"""Values that results depend on."""

# Fixed values -------------------------------------------------------------
EVENT_TYPES = {"clicks": 0, "carts": 1, "orders": 2}
RECALL_WEIGHTS = {"clicks": 0.10, "carts": 0.30, "orders": 0.60}
# Epoch seconds between which the recency weight of a click pair grows from 1 to 4.
CLICK_ANCHORS = (1659304800, 1662328791)
PAIR_TAIL = 30
CLICK_WINDOW = 1 * 24 * 60 * 60
CART_ORDER_WINDOW = 1 * 24 * 60 * 60
BUY_WINDOW = 7 * 24 * 60 * 60
TYPE_WEIGHTS = {0: 1.0, 1: 5.0, 2: 2.0}
TOP_PREDICTIONS = 20
# --------------------------------------------------------------------------

SECONDS_PER_DAY = 86400

# A key with more rows than this is cut into several tasks (see operators.ordering).
HOT_ROWS = 5_000_000
