"""Every threshold of the library, and the lookup tables it needs, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Detector:
    kind: str
    rolling: int
    multiplier: float
    margin: float
    min_count: int

    @property
    def half(self) -> int:
        return self.rolling // 2


# Alarm types and how likely each is a cause (1) rather than a symptom (0).
TYPE_PRIOR = {
    "network_down": 1.00, "disk_full": 0.95, "db_write_fail": 0.95, "ext_unreach": 0.90, "batch_overlap": 0.85, "pkt_loss": 0.80, "oom_risk": 0.80, "ext_slow": 0.70, "conn_refused": 0.60, "gc_pressure": 0.55,
    "batch_slow": 0.50, "thread_pool": 0.45, "db_conn_pool": 0.45, "txn_fail": 0.30, "queue_backlog": 0.30, "network_flap": 0.20, "mem_high": 0.20, "cpu_high": 0.20, "http_5xx": 0.15, "latency_high": 0.10,
    "timeout": 0.10, "disk_warn": 0.10, "cert_expiry": 0.05, "backup_warn": 0.05, "ntp_drift": 0.05, "log_rotate": 0.05,
}
# Weights of business criticality, and names of severities.
CRITICALITY_WEIGHT = {"kritik": 1.00, "yuksek": 0.75, "orta": 0.50, "dusuk": 0.25}
SEVERITY_LABEL = {1: "info", 2: "warning", 3: "minor", 4: "major", 5: "critical"}
# Types that are maintenance chatter at any severity.
MAINTENANCE_TYPES = ("cert_expiry", "backup_warn", "ntp_drift", "log_rotate", "disk_warn")
# Who owns which type.
OWNERS = {
    "network-oncall": ("network_down", "network_flap", "pkt_loss", "conn_refused"),
    "database-oncall": ("db_write_fail", "db_conn_pool"),
    "storage-oncall": ("disk_full", "disk_warn", "backup_warn"),
    "vendor-liaison": ("ext_unreach", "ext_slow"),
    "batch-oncall": ("batch_overlap", "batch_slow"),
}
# Known failure patterns as (key, root types, symptom types).
PATTERNS = (
    ("rack-network-partition", ("network_down", "pkt_loss", "network_flap"), ("conn_refused", "timeout", "thread_pool", "http_5xx", "latency_high")),
    ("storage-exhaustion-cascade", ("disk_full", "disk_warn"), ("db_write_fail", "txn_fail", "timeout", "http_5xx", "queue_backlog")),
    ("memory-leak-slow-burn", ("oom_risk", "gc_pressure", "mem_high"), ("latency_high", "timeout", "thread_pool", "http_5xx", "cpu_high")),
    ("upstream-provider-outage", ("ext_unreach", "ext_slow"), ("txn_fail", "timeout", "http_5xx", "latency_high", "queue_backlog")),
    ("db-pool-exhaustion", ("db_conn_pool",), ("timeout", "latency_high", "queue_backlog", "txn_fail", "thread_pool")),
    ("batch-window-collision", ("batch_overlap", "batch_slow"), ("queue_backlog", "latency_high", "cpu_high", "timeout")),
)


@dataclass(frozen=True)
class Params:
    burst: Detector = Detector("burst", 3, 3.0, 3.0, 6)
    slow: Detector = Detector("slow", 9, 1.8, 2.0, 9)
    island_gap: int = 2
    lonely_minutes: int = 30
    lonely_severity: int = 2
    background_severity: int = 3
    cluster_severity: int = 4
    burst_min_alarms: int = 3
    slow_min_alarms: int = 4
    slow_min_severity: int = 3
    onset_gap: int = 6
    locality_gap: int = 4
    max_hops: int = 2
    max_span: int = 30
    weights: dict[str, float] = field(default_factory=lambda: {"temporal": 35.0, "centrality": 25.0, "type_prior": 25.0, "severity": 10.0, "blast": 5.0})
    default_prior: float = 0.35
    gate_alarms: int = 10
    gate_services: int = 2
    gate_severity: int = 5
    gate_prior: float = 0.5
    cap: int = 15
    pattern_threshold: float = 0.45
    similar_threshold: float = 0.40


DEFAULT = Params()
MINUTE = 60_000_000
