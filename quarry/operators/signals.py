"""Detection signals of areas by a table of rules, feature trees, import summaries, and the sampling of phases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.text import glob_match
from quarry.operators.identity import blocked_keys
from quarry.sources.tables import staged

#: The files whose text counts as a manifest's.
MANIFESTS = (
    "**/package.json", "**/pom.xml", "**/build.gradle", "**/build.gradle.kts", "**/settings.gradle", "**/settings.gradle.kts", "**/Dockerfile", "**/dockerfile",
    "**/docker-compose*.yml", "**/docker-compose*.yaml", "**/*.tf", "**/pubspec.yaml", "**/.github/workflows/*.yml", "**/.github/workflows/*.yaml", "**/Jenkinsfile",
    "**/.gitlab-ci.yml", "**/vite.config.*", "**/webpack.config.*", "**/turbo.json", "**/nx.json",
)


@dataclass(frozen=True)
class Signal:
    """A rule: PATH (a file has the form), MENTION (a manifest names the token; the file is the first of the form, else the first of all) or
    CONTENT (a file of the form holds one of the tokens). `unless`: tokens whose mention rules it out, as in a chain of alternatives."""

    area: str
    technology: str
    weight: float
    kind: str
    glob: str
    tokens: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


def detect_signals(files: DataFrame, rules: Sequence[Signal], manifests: Sequence[str] = MANIFESTS) -> DataFrame:
    """snapshot_id, area, technology, weight, path, detail of the rules that hold in a snapshot of files (snapshot_id, path, text): the first
    file in path order and the token found there. One aggregate over the files for all rules, combined before the shuffle to a row a snapshot."""
    text = F.coalesce("text", F.lit(""))
    any_of = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    low, path = F.lower(text), F.col("path")
    named = sorted({t.lower() for r in rules for t in (r.tokens if r.kind == "MENTION" else ()) + r.unless})
    aggs = [F.min("path").alias("first"), *[F.bool_or(F.col("manifest") & low.contains(t)).alias(f"m{i}") for i, t in enumerate(named)]]
    for i, r in enumerate(rules):
        if r.kind == "CONTENT":
            token = F.coalesce(*[F.when(text.contains(t), F.lit(t)) for t in r.tokens])
            aggs.append(F.min(F.when(glob_match(path, r.glob) & token.isNotNull(), F.struct(path.alias("path"), token.alias("detail")))).alias(f"s{i}"))
        else:
            aggs.append(F.min(F.when(glob_match(path, r.glob), path)).alias(f"s{i}"))
    g = files.withColumn("manifest", any_of(glob_match(path, m) for m in manifests)).groupBy("snapshot_id").agg(*aggs)

    def held(i: int, r: Signal) -> Column:
        mention = lambda t: F.col(f"m{named.index(t.lower())}")
        if r.kind == "CONTENT":
            at, detail = F.col(f"s{i}.path"), F.col(f"s{i}.detail")
        elif r.kind == "MENTION":
            at, detail = F.when(mention(r.tokens[0]), F.coalesce(f"s{i}", "first")), F.lit(r.tokens[0])
        else:
            at, detail = F.col(f"s{i}"), F.lit(None).cast("string")
        at = F.when(~any_of(mention(t) for t in r.unless), at)
        return F.struct(F.lit(r.area).alias("area"), F.lit(r.technology).alias("technology"), F.lit(r.weight).alias("weight"), at.alias("path"), detail.alias("detail"))

    out = g.select("snapshot_id", F.explode(F.array(*[held(i, r) for i, r in enumerate(rules)])).alias("s"))
    return out.select("snapshot_id", "s.*").filter("path IS NOT NULL")


def feature_tree(features: DataFrame, max_depth: int = 32) -> DataFrame:
    """id, parent_id, root_id, depth, trail of the features (id, parent_id, name) that hang on one without parent; sorted by trail (the names
    from the root on) parents come before their children, and children by name. Features under a missing parent or on a cycle hang on none.
    Each level is written once and joined to its children; no list of children is gathered, so a wide parent is no large row."""
    rows = features.select("id", "parent_id", "name")
    level = staged(rows.filter("parent_id IS NULL").select("id", "parent_id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array("name").alias("trail")))
    levels = [level]
    while len(levels) < max_depth and not level.isEmpty():
        up = level.select(F.col("id").alias("parent_id"), "root_id", "depth", "trail")
        level = staged(rows.join(up, "parent_id").select("id", "parent_id", "root_id", (F.col("depth") + 1).alias("depth"), F.concat("trail", F.array("name")).alias("trail")))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


#: Fixed values of an import summary: its fields, the known reasons, and the greatest numbers.
POLICY = "local-ingest-v1"
REASONS = ("GENERATED_DIRECTORY", "SECRET_PATH", "IGNORED", "BINARY", "OVERSIZED", "FILE_LIMIT", "SYMLINK", "HARD_LINK", "SECRET_CONTENT", "SUBMODULE", "OUT_OF_SCOPE")
MAX_EXCERPT_BYTES, MAX_FILES, MAX_ENTRIES, MAX_BYTES_READ = 2048, 50_000, 200_000, 536_870_912


def import_summary(json: Column) -> Column:
    """The summary (accepted_files, bytes_read, excluded: reason -> count) of a JSON text, or null where it is not exactly one: malformed
    or too long, other fields than the five, a number that is no integer within its bounds, an unknown reason, or more entries than allowed."""
    # The parser stops at the end of a value; only as a member of both an array and an object is a text one value and nothing more.
    alone = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), json, F.lit("}"))).isNotNull()
    v = F.try_parse_json(F.when((F.octet_length(json) <= MAX_EXCERPT_BYTES) & alone, json))
    part = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    whole = lambda name, most: (F.schema_of_variant(part(name)) == "BIGINT") & F.try_variant_get(v, f"$.{name}", "bigint").between(0, most)
    reasons = [(r, f"excludedEntriesByReason.{r}") for r in REASONS]
    known = reduce(lambda a, b: a & b, [part(p).isNull() | whole(p, MAX_ENTRIES) for _, p in reasons])
    counts = F.array_compact(F.array(*[F.when(part(p).isNotNull(), F.struct(F.lit(r), F.try_variant_get(v, f"$.{p}", "bigint"))) for r, p in reasons]))
    total = F.aggregate(F.array(*[F.coalesce(F.try_variant_get(v, f"$.{p}", "bigint"), F.lit(0)) for _, p in reasons]), F.try_variant_get(v, "$.acceptedFiles", "bigint"), lambda a, x: a + x)
    fields = F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(f) for f in ("acceptedFiles", "bytesRead", "excludedEntriesByReason", "policyVersion", "schemaVersion")])
    excluded = F.json_object_keys(F.get_json_object(json, "$.excludedEntriesByReason"))
    good = (
        fields
        & whole("schemaVersion", 1) & (F.try_variant_get(v, "$.schemaVersion", "bigint") == 1)
        & (F.schema_of_variant(part("policyVersion")) == "STRING") & (F.try_variant_get(v, "$.policyVersion", "string") == POLICY)
        & whole("acceptedFiles", MAX_FILES) & whole("bytesRead", MAX_BYTES_READ)
        & F.schema_of_variant(part("excludedEntriesByReason")).startswith("OBJECT") & (F.size(F.array_except(excluded, F.array(*[F.lit(r) for r in REASONS]))) == 0)
        & known & (total <= MAX_ENTRIES)
    )
    value = F.struct(
        F.try_variant_get(v, "$.acceptedFiles", "int").alias("accepted_files"),
        F.try_variant_get(v, "$.bytesRead", "bigint").alias("bytes_read"),
        F.map_from_entries(counts).alias("excluded"),
    )
    return F.when(v.isNotNull() & good, value)


def phase_sampling(samples: DataFrame, phases: DataFrame, max_gap_ms: int = 250) -> DataFrame:
    """run, phase, n, max_gap, peak, complete of the phases (run, phase, start_ms, end_ms) from samples (run, phase, t_ms, value, owner).

    The gaps include those from a phase's start to its first sample and from its last to its end. A phase is complete if it has a sample,
    no wider gap than allowed, and its run has no sample that missed its owner."""
    at = samples.select("run", "phase", F.col("t_ms").cast("long").alias("t_ms"), "value", F.lit(1).alias("n"))
    edge = lambda c: phases.select("run", "phase", F.col(c).cast("long").alias("t_ms"), F.lit(None).cast(samples.schema["value"].dataType).alias("value"), F.lit(0).alias("n"))
    rows = at.join(phases.select("run", "phase").distinct(), ["run", "phase"], "left_semi").unionByName(edge("start_ms")).unionByName(edge("end_ms"))
    gap = F.col("t_ms") - F.lag("t_ms").over(W.partitionBy("run", "phase").orderBy("t_ms"))
    g = rows.withColumn("gap", gap).groupBy("run", "phase").agg(F.sum("n").alias("n"), F.max("gap").alias("max_gap"), F.max("value").alias("peak"))
    missed = samples.filter("NOT owner").select("run").distinct().withColumn("missed", F.lit(True))
    complete = (F.col("n") > 0) & (F.col("max_gap") <= max_gap_ms) & F.col("missed").isNull()
    return g.join(missed, "run", "left").select("run", "phase", "n", "max_gap", "peak", complete.alias("complete"))


def guarded_outcomes(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """path, status of the files' outcomes: files that declare an ambiguous identity become PARTIAL unless they FAILED, also such without outcome."""
    declared = nodes.filter("path IS NOT NULL AND line_start IS NOT NULL AND node_type <> 'PACKAGE'")
    hit = declared.join(blocked_keys(nodes), "natural_key", "left_semi").select("path").distinct().withColumn("hit", F.lit(True))
    status = F.when(F.col("hit") & (F.coalesce("status", F.lit("")) != "FAILED"), "PARTIAL").otherwise(F.col("status"))
    return outcomes.select("path", "status").join(hit, "path", "full").select("path", status.alias("status"))
