"""Record types of the unified alert table and the fixed lookup values."""

from pyspark.sql import types as T

UNIFIED = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.DoubleType()),
    T.StructField("dst_port", T.DoubleType()),
    T.StructField("service", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("vantage", T.StringType()),
    T.StructField("source_dataset", T.StringType()),
    T.StructField("campaign_id", T.StringType()),
    T.StructField("kill_chain_stage", T.StringType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("is_campaign_link", T.BooleanType()),
])
UNIFIED_COLUMNS = UNIFIED.fieldNames()

SESSION_EXTRAS = T.StructType([
    T.StructField("scenario", T.StringType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("event_count", T.LongType()),
])
FLOW_EXTRAS = T.StructType([
    T.StructField("day", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("predicted_attack_type", T.StringType()),
    T.StructField("predicted_attack_type_agreement", T.DoubleType()),
    T.StructField("predicted_kill_chain_stage", T.StringType()),
])
SPLIT = T.StructType([
    T.StructField("campaign_id", T.StringType()),
    T.StructField("split", T.StringType()),
])

NO_CAMPAIGN = "NONE"
UNKNOWN_STAGE = "unknown"

# Kill-chain vocabulary and the ordinals used as a feature.
STAGE_ORDINAL = {"recon": 0, "exploit": 1, "install": 2, "action": 3}
UNKNOWN_ORDINAL = -1

# What each phase of the session captures means.
PHASE_STAGE = {1: "recon", 2: "recon", 3: "exploit", 4: "install", 5: "action"}
PHASE_ATTACK_TYPE = {1: "recon", 2: "recon", 3: "exploit", 4: "backdoor_install", 5: "ddos"}

# Flow label to kill-chain stage, spelled as published.
LABEL_STAGE = {
    "FTP-Patator": "recon",
    "SSH-Patator": "recon",
    "Web_Brute_Force": "recon",
    "Port_Scan": "recon",
    "Web_XSS": "exploit",
    "Web_SQL_Injection": "exploit",
    "Heartbleed": "exploit",
    "DoS Hulk": "action",
    "DoS GoldenEye": "action",
    "DoS Slowhttptest": "action",
    "DoS Slowloris": "action",
    "DDoS": "action",
    "Botnet_ARES": "action",
    "Benign": "unknown",
}
# Labels found in the flow files that the published table does not spell.
LABEL_STAGE_ADDED = {"DDoS_LOIT": "action"}

# Capture day of every flow file.
FLOW_FILE_DAY = {
    "ftp_patator.csv": "tue",
    "ssh_patator-new.csv": "tue",
    "tuesday_benign.csv": "tue",
    "dos_slowloris.csv": "wed",
    "dos_slowhttptest.csv": "wed",
    "dos_hulk.csv": "wed",
    "dos_golden_eye.csv": "wed",
    "heartbleed.csv": "wed",
    "wednesday_benign.csv": "wed",
    "web_brute_force.csv": "thu",
    "web_xss.csv": "thu",
    "web_sql_injection.csv": "thu",
    "thursday_benign.csv": "thu",
    "botnet_ares.csv": "fri",
    "portscan.csv": "fri",
    "ddos_loit.csv": "fri",
    "friday_benign.csv": "fri",
    "monday_benign.csv": "mon",
}

# Columns that give the answer away and are never features.
FLOW_LEAKAGE_COLUMNS = ["flow_id", "timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "label"]
FLOW_LIGHT_COLUMNS = ["timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "label"]
SECOND_FLOW_NON_FEATURES = ["id", "attack_cat", "label"]
SECOND_FLOW_CATEGORICAL = ["proto", "service", "state"]
SECOND_FLOW_TTL_COLUMNS = ["sttl", "dttl"]

# Classes shown in the short report.
HEADLINE_CLASSES = ["Web_SQL_Injection", "Web_XSS", "Port_Scan", "Benign"]

# Layout and names of the session captures.
SCENARIOS = ["LLS_DDOS_1.0", "LLS_DDOS_2.0.2"]
VANTAGE_DIRS = {"tcpdump_inside": "inside", "tcpdump_dmz": "dmz"}
TEST_ONLY_SOURCES = ["darpa2000_lldos1.0", "darpa2000_lldos2.0.2"]
INTERNAL_PREFIX = "172.16."

# Thresholds and budgets.
BURST_THRESHOLD = 200
BURST_BIN_SECONDS = 1
CAMPAIGN_GAP_MINUTES = 60
BENIGN_MULTIPLIER = 5
BENIGN_CAP = 50_000
BENIGN_FLOOR = 1_000
BENIGN_TOTAL_TARGET = 100_000
TRAIN_FRACTION = 0.7
VALIDATION_FRACTION = 0.3
SEED = 42
NEAR_PERFECT_F1 = 0.98
LOW_POWER_SUPPORT = 15
AUDIT_RECALL = 0.99
AUDIT_SUPPORT = 100
ABLATION_DELTA = 0.02
STABLE_STD = 0.15
OPEN_WINDOW_SECONDS = 3600
RULE_WINDOW_MINUTES = 30
POOL_SIZE = 60
POOL_TRUE_SHARE = 0.6
DISTRACTOR_BUFFER_MINUTES = 30
REWARD_TRUE_POSITIVE = 1.0
REWARD_FALSE_POSITIVE = -1.0
REWARD_FALSE_NEGATIVE = -2.5
REWARD_TRUE_NEGATIVE = 0.1
