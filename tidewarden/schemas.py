"""Row shapes of the event feeds and of the derived tables, as DDL text."""

HEARTBEAT = "timestamp string, service string, host string, agent string"
STATUS = (
    "timestamp string, service string, host string, agent string, track array<string>, "
    "tags map<string,string>, value string, message string"
)
ALERT = (
    "timestamp string, service string, host string, severity string, description string, "
    "data map<string,string>"
)
PAGER = (
    "timestamp string, service string, host string, page boolean, "
    "data struct<type:string,incidentKey:string,serviceKey:string,description:string,"
    "details:string>"
)

FEEDS = {"heartbeats": HEARTBEAT, "statuses": STATUS, "alerts": ALERT, "pagers": PAGER}

STATUS_TABLE = (
    "ts timestamp, service string, host string, agent string, track array<string>, "
    "tags map<string,string>, value string, message string, arrival bigint"
)

# Severities named by the feeds. WARN and ERROR are kept as they are.
SEVERITIES = ("ANOMALY", "COMPONENT_FAILURE", "SERVICE_FAILURE", "DEFAULT", "WARN", "ERROR")
