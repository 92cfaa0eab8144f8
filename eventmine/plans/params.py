"""Parameters of the registered queries (the values the oracle SQL repeats)."""

CUTOFFS = ["2024-01-11 00:00:00", "2024-01-16 00:00:00", "2024-01-21 00:00:00"]
HORIZON = "1d"
SESSION_GAP = "8h"
FUNNEL_STEPS = ["view", "click", "purchase"]
FUNNEL_WITHIN = "6h"
TRAILING = {"1d": "1d", "7d": "7d"}
TS_BUCKET = "1d"           # time bucket for per-user ordered scans
RETENTION_PERIOD = "week"
AUDIENCE_A = ("2024-01-08 00:00:00", "2024-01-15 00:00:00")
AUDIENCE_B = ("2024-01-15 00:00:00", "2024-01-22 00:00:00")
SPLIT_BUCKETS = 10
NEG_RATIO = 1.0
NEG_SEED = 7
PRIOR_WEIGHT = 10.0
TOP_K = 3
PAIR_MIN_COUNT = 20
RFM_AS_OF = "2001-08-02 00:00:00"
RANK_SPLIT = "1999-01-01 00:00:00"
WINDOW_WIDTH = "1d"
WINDOW_SLIDE = "12h"
STREAM_DELAY = "1h"
STATE_TTL = "3d"
FP_MIN_SUPPORT = 0.005
