"""Fixed values that results depend on. They are part of the data contract, not tuning knobs."""

# --- fixed values -----------------------------------------------------------------------------
DATASET_TYPES = ("text", "integer", "number", "boolean")
TRUE_WORDS = ("true", "1", "yes", "是")
DELIMITERS = (",", ";", "\t", "|")
BLANK_HEADER_PREFIX = "未命名字段_"
NOISE_NAME = "噪声"
CLUSTER_NAME_PREFIX = "聚类 "
PAGE_LABEL = ("第 ", " 页")
ALL_ROWS_GROUP = "__all__"

PREVIEW_ROWS = 100
RESIDUAL_ROWS = 500
ASSIGNMENT_ROWS = 500
PREDICTION_ROWS = 200
EMBEDDING_ROWS = 2000
IMPORTANCE_ROWS = 100
MARKDOWN_PREVIEW_CHARS = 4000
MIN_PAGE_TEXT = 20
HISTOGRAM_BINS = 12
SAMPLE_ROWS = 50_000

MAX_ARCHIVE_FILES = 2000
MAX_ARCHIVE_BYTES = 512 * 1024 * 1024
MIN_SUPERVISED_ROWS = 20
MIN_CLUSTER_ROWS = 3
MIN_ANOVA_ROWS = 20
MIN_TRAIN_WINDOWS = 10
MIN_TEST_WINDOWS = 5
# ----------------------------------------------------------------------------------------------
