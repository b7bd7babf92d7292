"""Column lists of the tables the library works on."""

FILES = "snapshot_id long, path string, language string, size long, line_count int, content_hash string, analysis_status string"
NODES = "snapshot_id long, node_type string, natural_key string, name string, path string, line_start int, area_type string, metadata string"
EDGES = "snapshot_id long, source string, target string, edge_type string, confidence string"
SAMPLES = "sequence int, elapsed_ms long, phase string, pid int, ppid int, rss_kib long, scope_owner_pid int"
JOB_EVENTS = "job_id long, seq long, ts timestamp, state string"
