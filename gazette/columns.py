"""Default column names (fixed values of the impression-log data model)."""

# impressions
IMPRESSION_ID = "impression_id"
USER = "user_id"
ARTICLE_ID = "article_id"
SESSION_ID = "session_id"
IMPRESSION_TIME = "impression_time"
INVIEW = "article_ids_inview"
CLICKED = "article_ids_clicked"
READ_TIME = "read_time"
SCROLL = "scroll_percentage"
NEXT_READ_TIME = "next_read_time"
NEXT_SCROLL = "next_scroll_percentage"
DEVICE = "device_type"
POSTCODE = "postcode"
GENDER = "gender"
AGE = "age"
IS_SSO_USER = "is_sso_user"
IS_SUBSCRIBER = "is_subscriber"
IS_BEYOND_ACCURACY = "is_beyond_accuracy"

# articles
TITLE = "title"
SUBTITLE = "subtitle"
BODY = "body"
URL = "url"
ARTICLE_TYPE = "article_type"
CATEGORY = "category"
CATEGORY_STR = "category_str"
SUBCATEGORY = "subcategory"
TOPICS = "topics"
ENTITIES = "entity_groups"
NER = "ner_clusters"
IMAGE_IDS = "image_ids"
PREMIUM = "premium"
SENTIMENT_LABEL = "sentiment_label"
SENTIMENT_SCORE = "sentiment_score"
TOTAL_INVIEWS = "total_inviews"
TOTAL_PAGEVIEWS = "total_pageviews"
TOTAL_READ_TIME = "total_read_time"
MODIFIED_TIME = "last_modified_time"
PUBLISHED_TIME = "published_time"

# histories
HISTORY_IDS = "article_id_fixed"
HISTORY_TIMES = "impression_time_fixed"
HISTORY_READ_TIMES = "read_time_fixed"
HISTORY_SCROLLS = "scroll_percentage_fixed"

# derived
KNOWN_USER = "is_known_user"
LABELS = "labels"
SCORES = "prediction_scores"
