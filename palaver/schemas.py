"""Declared schemas and fixed values of the chat tables."""

from pyspark.sql import types as T

STRING, LONG, INT, DOUBLE, NTZ = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.TimestampNTZType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MESSAGE = _struct(author_name=STRING, user_type=STRING, date=STRING, text=STRING, agent_id=STRING)
TRANSCRIPT = T.ArrayType(MESSAGE)

AGENT_COLUMN = "agents.1.display_name"  # the dots belong to the name: quote it with backticks

CHATS = T.StructType(
    [
        T.StructField("ID", STRING),
        T.StructField("UserID", LONG),
        T.StructField("Messages", STRING),
        T.StructField("rate", STRING),
        T.StructField("duration", LONG),
        T.StructField("started", NTZ),
        T.StructField("tags", STRING),
        T.StructField("AgentMessagesCount", INT),
        T.StructField("VisitorMessagesCount", INT),
        T.StructField(AGENT_COLUMN, STRING),
    ]
)

PROFILE = _struct(UserID=LONG, VIPlevelNo=INT, BrandFriendlyName=STRING, CountryGroup1=STRING)

PHRASES = _struct(FilterMessages=STRING)

# Order of the serving table; `ChatID` stands where the stored file says `ID`.
FACT = _struct(
    text=STRING,
    UserID=LONG,
    Date=NTZ,
    VIPLevel=INT,
    Rating=STRING,
    DurationInMins=DOUBLE,
    Brand=STRING,
    CountryGroup1=STRING,
    ChatType=STRING,
    ChatID=STRING,
    AgentDisplayName=STRING,
    html_text=STRING,
    Negative=DOUBLE,
    Neutral=DOUBLE,
    Positive=DOUBLE,
    Sentiment=STRING,
)

# The warehouse form of the fact: scores to two places, a load time.
FACT_TABLE = T.StructType(
    [
        T.StructField("ChatID", STRING),
        T.StructField("text", STRING),
        T.StructField("UserID", INT),
        T.StructField("Date", NTZ),
        T.StructField("VIPLevel", T.ShortType()),
        T.StructField("Rating", STRING),
        T.StructField("DurationInMins", T.DecimalType(12, 2)),
        T.StructField("Brand", STRING),
        T.StructField("CountryGroup1", STRING),
        T.StructField("ChatType", STRING),
        T.StructField("Negative_Score", T.DecimalType(18, 2)),
        T.StructField("Neutral_Score", T.DecimalType(18, 2)),
        T.StructField("Positive_Score", T.DecimalType(18, 2)),
        T.StructField("Sentiment", STRING),
        T.StructField("html_text", STRING),
        T.StructField("TransactionDate", NTZ),
        T.StructField("AgentDisplayName", STRING),
    ]
)

AUDIT = _struct(
    Project=STRING,
    TrainOrPredict=STRING,
    Stat1=DOUBLE,
    Stat1Desc=STRING,
    Stat2=DOUBLE,
    Stat2Desc=STRING,
    Stat3=DOUBLE,
    Stat3Desc=STRING,
    RecordCount=LONG,
    Comments=STRING,
)

NEAREST = _struct(UserID=LONG, UserID_VIP=LONG, Distance=DOUBLE, Country=STRING, RN=INT)

# Labels, sentinels, mask words and display names that results must carry.
SENTIMENTS = ("Negative", "Neutral", "Positive")
CHATBOT_CHAT = "Chatbot Chat"
SUPPORT_CHAT = "Support Chat"
ALL_BRANDS = "All Brands"
ALL_COUNTRIES = "All Countries"
ALL_AGENTS = "All Agents"
EMAIL_MASK = "<EMAIL>"
PHONE_MASK = "<PHONE NUMBER>"
URL_MASK = "<URL>"
RUN_STAMP = "yyyyMMdd_HH_mm_ss"
DISPLAY_NAMES = {
    "text": "Text",
    "UserID": "User ID",
    "Date": "Date",
    "VIPLevel": "VIP Level",
    "Rating": "Rating",
    "DurationInMins": "Duration (Mins)",
    "Brand": "Brand",
    "CountryGroup1": "Country Group",
    "ChatType": "Chat Type",
    "ChatID": "Chat ID",
    "AgentDisplayName": "Agent",
    "Negative": "Negative Score",
    "Neutral": "Neutral Score",
    "Positive": "Positive Score",
    "Sentiment": "Sentiment",
}
IMPUTED = {"VIPLevel": 0, "Brand": "", "CountryGroup1": ""}
