"""Document and audit schemas, and the values fixed by the data formats.

A document is one row: metadata (``_index``, ``_id``, ``_day``), the event time,
promoted typed columns for the paths that queries filter on, and ``fields``, a map
from every dotted leaf path to its JSON text. A null value is the text ``null``,
so "present but null" and "missing" stay different.
"""

from __future__ import annotations

TS = "@timestamp"

# Dotted path -> type of its promoted column. The column is the path with "_" for ".".
PROMOTED: dict[str, str] = {
    "event.dataset": "string",
    "event.duration": "bigint",
    "event.created": "timestamp",
    "alert.severity": "int",
    "alert.signature": "string",
    "alert.category": "string",
    "alert.action": "string",
    "alert.signature_id": "bigint",
    "rule.name": "string",
    "source.ip": "string",
    "source.port": "int",
    "destination.ip": "string",
    "destination.port": "int",
    "network.transport": "string",
    "network.bytes": "bigint",
    "network.packets": "bigint",
    "flow.pkts_toserver": "bigint",
    "flow.pkts_toclient": "bigint",
    "flow.bytes_toserver": "bigint",
    "flow.bytes_toclient": "bigint",
    "flow_id": "bigint",
    "message2.app_proto": "string",
    "tags": "array<string>",
    "message": "string",
    "source_type": "string",
    "module": "string",
    "error.message": "string",
    "parse_error": "string",
}


def column_of(path: str) -> str:
    return path.replace(".", "_")


def document_ddl() -> str:
    """The document table as a DDL string."""
    promoted = ", ".join(f"`{column_of(p)}` {t}" for p, t in PROMOTED.items())
    return (
        f"`_index` string, `_id` string, `_day` date, `{TS}` timestamp, {promoted}, "
        "`fields` map<string,string>, `_malformed` array<string>"
    )


AUDIT_DDL = (
    "run_id string, run_seq bigint, op_seq bigint, `@timestamp` timestamp, enrichment string, "
    "cluster string, `index` string, doc_id string, doc_day date, operation string, "
    "changed_fields array<string>, rollback_supported boolean, "
    "before map<string,struct<exists:boolean,value:string>>, after map<string,string>, "
    "reverts_run_id string"
)

# Fixed values of the data formats ------------------------------------------------

SEVERITY_CODES = {"critical": 1, "high": 2, "medium": 3, "low": 4}

# Top-level keys that do not count as extracted fields.
BOOKKEEPING_KEYS = ["message", "@timestamp", "event", "ecs", "tags", "error", "parse_error"]

# Fields dropped when log lines are shipped, and the constants added to them.
SHIP_DROP = ["agent.hostname", "ecs", "host", "input", "log"]
SHIP_CONSTANTS = {"source_type": "suricata", "module": "suricata", "tags": ["suricata"]}

HOME_NET = [
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "100.64.0.0/10",
    "127.0.0.0/24",
    "169.254.0.0/16",
    "fc00::/7",
    "::1/128",
]

SUPPRESSED_SIDS = [2200073, 2200074, 2200075, 2200076, 2200077, 2200078, 2200079, 2200121]

RULE_ACTIONS = ["alert", "pass", "drop", "reject", "rejectsrc", "rejectdst", "rejectboth"]

DATE_FORMATS = ["ISO8601", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd-HH:mm:ssX"]

ALERT_VIEW_FILTER = {
    "bool": {
        "should": [
            {"term": {"event.dataset": "alert"}},
            {"term": {"event.dataset": "suricata.alert"}},
            {"term": {"tags": "alert"}},
        ],
        "minimum_should_match": 1,
    }
}

ALERT_FIELDS = [
    TS,
    "alert.signature",
    "alert.severity",
    "alert.category",
    "alert.action",
    "source.ip",
    "destination.ip",
    "destination.port",
    "network.transport",
    "event.dataset",
    "rule.name",
    "tags",
]

FLOW_FIELDS = [
    TS,
    "source.ip",
    "source.port",
    "destination.ip",
    "destination.port",
    "network.transport",
    "network.bytes",
    "network.packets",
    "event.duration",
    "flow.pkts_toserver",
    "flow.pkts_toclient",
    "flow.bytes_toserver",
    "flow.bytes_toclient",
]


# Categories of log sources by keywords in the vendor's lower-cased name, in order of precedence.
VENDOR_PREFIXES = [("ti ", "Threat Intel")]
VENDOR_KEYWORDS = [
    ("Threat Intel", ["threat intel", "threatconnect", "opencti", "misp", "greynoise", "recordedfuture", "flashpoint", "anomali", "cybersixgill", "cyware", "domaintools", "eclecticiq", "mandiant", "abuse.ch", "abusech", "threatq", "otx", "anyrun", "epss"]),
    ("Endpoint", ["crowdstrike", "carbon black", "carbonblack", "cybereason", "sentinel one", "sentinelone", "cylance", "symantec", "trendmicro", "trend micro", "sophos", "bitdefender", "eset", "jamf", "trellix", "fireeye", "digital guardian", "nextron", "claroty", "forescout", "tanium", "tetragon", "sysdig", "falco", "osquery", "vectra", "darktrace", "cyera", "withsecure", "armis", "nozomi", "airlock"]),
    ("Identity", ["okta", "ldap", "duo", "pingidentity", "auth0", "authentik", "beyondtrust", "beyondinsight", "cyberark", "jumpcloud", "keycloak", "forgerock", "ping ", "sailpoint", "teleport", "thycotic", "hashicorp vault", "1password", "bitwarden", "lastpass", "entityanalytics", "keeper", "identity", "lumos", "entro"]),
    ("Windows", ["windows", "sysmon", "microsoft", "active directory", "m365 ", "o365", "entra", "defender", "intune"]),
    ("Linux", ["linux", "syslog", "ubuntu", "debian", "rhel", "centos", "auditd", "macos", "santa", "iptables"]),
    ("Cloud", ["aws ", "azure", "gcp", "google ", "cloudtrail", "salesforce", "amazon security", "tencent cloud", "awsfirehose"]),
    ("Network", ["suricata", "zeek", "snort", "palo", "cisco", "fortinet", "checkpoint", "juniper", "arista", "f5 ", "sonicwall", "pfsense", "watchguard", "bluecoat", "forcepoint", "stormshield", "netflow", "network traffic", "radware", "netscout", "pulse connect", "proxysg", "squid", "zscaler", "netskope", "akamai", "cloudflare", "extrahop", "goflow", "hpe aruba", "imperva", "haproxy", "traefik", "envoyproxy", "prisma access"]),
    ("Email", ["proofpoint", "mimecast", "ironscales", "sublime security", "barracuda", "checkpoint email", "abnormal"]),
    ("Database", ["mysql", "postgresql", "oracle ", "mongodb", "redis", "cassandra", "couchdb", "couchbase", "memcached", "cockroachdb", "influxdb", "etcd", "rabbitmq", "kafka", "nats ", "elasticsearch", "ceph", "ibmmq"]),
    ("Security Ops", ["splunk", "qradar", "ibm q", "rapid7", "swimlane", "tines", "elastic agent", "elastic package", "elastic security", "logstash", "kibana", "cribl", "canva", "wiz ", "servicenow", "tenable", "qualys", "snyk", "rubrik"]),
    ("DevOps/Web", ["kubernetes", "docker", "gitlab", "github", "jenkins", "istio", "coredns", "grafana", "prometheus", "golang", "spring boot", "airflow", "apache spark", "activemq", "vsphere", "netbox", "nginx", "apache ", "tomcat", "iis", "citrix", "modsecurity", "php fpm", "websphere"]),
]
