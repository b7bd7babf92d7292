"""YAML files as rows, and what configuration says: services, cluster resources, jobs, application settings and their edges.

One helper reads a file into rows (document, path of keys, value, line); all else is filters, groups and joins of those rows."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import base_name

ROWS = "file string, document int, path array<string>, kind string, value string, line int"
KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#&*!|>'\"%@`\[\]{},:-](?:[^:#]|:(?=\S)|(?<=\S)#)*?|-[^\s:](?:[^:#]|:(?=\S)|(?<=\S)#)*?)\s*:(?:\s+(.*))?$", re.S)
NULLS = ("", "~", "null", "Null", "NULL")
DEEPEST = 60
#: Kinds of cluster resources that run containers, and others that are told.
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob")
CLOUD = ("Service", "Ingress", "ConfigMap", "Secret", "PersistentVolumeClaim", "Namespace")


class Refused(ValueError):
    pass


def _bare(text: str) -> str:
    """A line's content without a comment at its end."""
    if "#" not in text:
        return text.rstrip()
    m = re.match(r"((?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^#]|(?<=\S)#)*)", text)
    return m[1].rstrip()


def _scalar(text: str, line: int) -> str | None:
    if text in NULLS:
        return None
    if text[0] in "&*!":
        raise Refused(f"anchors and tags are not read: line {line}")
    if text[0] in "\"'":
        if len(text) < 2 or text[-1] != text[0] or not KEY.fullmatch(text + ":"):
            raise Refused(f"a quoted value of several lines is not read: line {line}")
        body = text[1:-1]
        return body.replace("''", "'") if text[0] == "'" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), body)
    if text[0] in "{[%@`":
        raise Refused(f"flow style is read for lists of plain values only: line {line}")
    return text


class Reader:
    """Rows of one document: a walk down its lines by indentation."""

    def __init__(self, lines: list[tuple[int, str]]):
        self.lines, self.at, self.rows = lines, 0, []

    def peek(self) -> tuple[int, int, str] | None:
        """(line, indent, content) of the next line that has any."""
        while self.at < len(self.lines):
            number, raw = self.lines[self.at]
            text = _bare(raw)
            body = text.lstrip(" ")
            if body:
                if body[0] == "\t":
                    raise Refused(f"indented by a tab: line {number}")
                return number, len(text) - len(body), body
            self.at += 1
        return None

    def value(self, text: str, number: int, indent: int, path: list[str]) -> None:
        """The value that stands behind a key or a dash of this indent."""
        if text[:1] in ("|", ">") and re.fullmatch(r"[|>][-+0-9]*", text):
            held = []
            while self.at < len(self.lines):
                raw = self.lines[self.at][1]
                if raw.strip() and len(raw) - len(raw.lstrip(" ")) <= indent:
                    break
                held.append(raw.rstrip())
                self.at += 1
            self.rows.append((path, "SCALAR", ("\n" if text[0] == "|" else " ").join(textwrap.dedent("\n".join(held)).split("\n")).strip(), number))
        elif text in ("[]", "{}"):
            self.rows.append((path, "LIST" if text == "[]" else "MAP", None, number))
        elif text[:1] == "[" and re.fullmatch(r"\[[^\[\]{}&*!]*\]", text):
            self.rows.append((path, "LIST", None, number))
            for i, x in enumerate(re.findall(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^,\s][^,]*", text[1:-1])):
                self.rows.append(([*path, f"[{i}]"], "SCALAR", _scalar(x.strip(), number), number))
        else:
            self.rows.append((path, "SCALAR", _scalar(text, number), number))

    def node(self, indent: int, path: list[str], line: int | None = None) -> None:
        if len(path) > DEEPEST:
            raise Refused("nested too deep")
        number, _, body = self.peek()
        dash = body == "-" or body.startswith("- ")
        self.rows.append((path, "LIST" if dash else "MAP", None, line or number))
        k = 0
        while (now := self.peek()) and now[1] == indent:
            number, _, body = now
            if (body == "-" or body.startswith("- ")) != dash:
                break
            if dash:
                rest = body[1:].lstrip()
                below, k = [*path, f"[{k}]"], k + 1
                inner = indent + len(body) - len(rest)
                if rest and (KEY.match(rest) or rest == "-" or rest.startswith("- ")):
                    self.lines[self.at] = (number, " " * inner + rest)
                    self.node(inner, below)
                    continue
            else:
                m = KEY.match(body)
                if not m:
                    raise Refused(f"neither a key nor an item: line {number}")
                rest, below = (m[2] or "").strip(), [*path, _scalar(m[1], number) or ""]
            self.at += 1
            if rest:
                self.value(rest, number, indent, below)
            elif (after := self.peek()) and (after[1] > indent or not dash and after[1] == indent and (after[2] == "-" or after[2].startswith("- "))):
                self.node(after[1], below, number)
            else:
                self.rows.append((below, "SCALAR", None, number))
        if now and now[1] > indent:
            raise Refused(f"indented unlike its neighbours: line {now[0]}")


def read_yaml(text: str) -> list[tuple]:
    """(document, path, kind, value, line): MAP and LIST for nodes, SCALAR for values (null where there is none). A text that is not read whole is one row of
    kind REFUSED, with the reason for its value."""
    documents, out = [[]], []
    for number, raw in enumerate(text.splitlines(), 1):
        if re.match(r"---(\s|$)|\.\.\.\s*$", raw):
            documents.append([(number, raw[3:])])
        elif not (raw.startswith("%") and not any(r.strip() for _, r in documents[-1])):
            documents[-1].append((number, raw))
    place = 0
    try:
        for lines in documents:
            reader = Reader(lines)
            if first := reader.peek():
                if first[2] in ("{}", "[]"):
                    reader.at += 1
                    reader.rows.append(([], "MAP" if first[2] == "{}" else "LIST", None, first[0]))
                elif KEY.match(first[2]) or first[2].startswith("-"):
                    reader.node(first[1], [])
                if rest := reader.peek():
                    raise Refused(f"neither a key nor an item, or indented unlike its neighbours: line {rest[0]}")
                out += [(place, *r) for r in reader.rows]
                place += 1
    except (Refused, RecursionError) as e:
        return [(0, [], "REFUSED", str(e), None)]
    return out


def yaml_rows(files: DataFrame) -> DataFrame:
    """file, document, path, kind, value, line of the YAML files among (path, text). Each file is read alone; a null text is empty."""
    src = files.filter(F.lower("path").rlike(r"\.ya?ml$")).select("path", F.coalesce("text", F.lit("")).alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, t in b.itertuples(index=False) for r in read_yaml(t)]
            yield pd.DataFrame(rows, columns=["file", "document", "path", "kind", "value", "line"], dtype=object)

    return src.mapInPandas(read, ROWS)


def _at(*keys: str) -> Column:
    """Rows at exactly this path."""
    return F.col("path") == F.array(*map(F.lit, keys)).cast("array<string>")


def _words(here: Column, depth: Column | int, cut: Column | None = None) -> Column:
    """What a list or map below `here` (rows whose path goes on at `depth`) says, in order: values of items, keys of maps and of items that are maps; of a single value,
    itself. One file's part of one service."""
    n, item = F.size("path"), lambda i: F.get("path", i).rlike(r"^\[\d+\]$")
    depth = F.lit(depth) if isinstance(depth, int) else depth
    scalar = F.col("kind") == "SCALAR"
    cut = F.col("value") if cut is None else cut
    word = F.when((n == depth) & scalar, F.col("value")).when((n == depth + 1) & item(depth) & scalar, cut).when((n == depth + 1) & ~item(depth), F.get("path", depth)).when((n == depth + 2) & item(depth) & ~item(depth + 1), F.get("path", depth + 1))
    found = F.collect_list(F.when(here & word.isNotNull(), F.struct("line", "path", word.alias("w"))))
    return F.transform(F.array_sort(found), lambda s: s["w"])


def compose_services(rows: DataFrame) -> DataFrame:
    """file, service, line, image, ports, environment_keys, depends_on, context, dockerfile of compose files. A service is built where context or dockerfile are given."""
    name = F.lower(base_name(F.col("file")))
    r = rows.filter(name.isin("compose.yml", "compose.yaml") | name.rlike(r"^docker-compose.*\.ya?ml$")).filter((F.get("path", 0) == "services") & (F.size("path") > 1))
    part, n = F.get("path", 2), F.size("path")
    one = lambda *keys: F.max(F.when((n == 2 + len(keys)) & (F.slice("path", 3, len(keys)) == F.array(*map(F.lit, keys))), F.col("value")))
    env = (part == "environment") & (n == 4)
    keys = F.transform(F.array_sort(F.collect_list(F.when(env, F.struct("line", "path", F.when(F.get("path", 3).rlike(r"^\[\d+\]$"), F.substring_index("value", "=", 1)).otherwise(F.get("path", 3)).alias("w"))))), lambda s: s["w"])
    built = F.max(F.when(part == "build", F.lit(True)))
    return r.groupBy("file", F.get("path", 1).alias("service")).agg(
        F.min("line").alias("line"),
        one("image").alias("image"),
        _words(part == "ports", 3).alias("ports"),
        keys.alias("environment_keys"),
        _words(part == "depends_on", 3).alias("depends_on"),
        F.when(built, F.coalesce(one("build", "context"), one("build"), F.lit("."))).alias("context"),
        F.when(built, F.coalesce(one("build", "dockerfile"), F.lit("Dockerfile"))).alias("dockerfile"),
    )


def cluster_resources(rows: DataFrame) -> DataFrame:
    """file, document, item, node_type, natural_key, kind, name, namespace, replicas, images, line of workloads (containers) and other resources; the items of a List each."""
    low, name = F.lower("file"), F.lower(base_name(F.col("file")))
    r = rows.filter(~low.rlike(r"(^|/)\.github/") & ~name.rlike(r"^(docker-compose|compose\.|chart\.)") & ~F.contains(low, F.lit("/tests/")) & (F.col("kind") != "REFUSED"))
    lists = r.filter(_at("kind") & (F.lower("value") == "list")).select("file", "document", F.lit(True).alias("list"))
    r = r.join(lists, ["file", "document"], "left")
    inside = F.coalesce("list", F.lit(False))
    item = F.when(inside, F.get("path", 1)).otherwise("")
    r = r.filter(~inside | (F.get("path", 0) == "items") & (F.size("path") > 1)).withColumn("item", item).withColumn("path", F.when(inside, F.slice("path", F.lit(3), F.size("path"))).otherwise(F.col("path")))
    one = lambda *keys: F.max(F.when(_at(*keys), F.col("value")))
    image = (F.size("path") == 6) & (F.array_join(F.slice("path", 1, 4), "\u0001") == "\u0001".join(("spec", "template", "spec", "containers"))) & (F.get("path", 5) == "image") & F.col("value").isNotNull()
    g = r.groupBy("file", "document", "item").agg(
        one("kind").alias("kind"),
        one("metadata", "name").alias("name"),
        F.coalesce(one("metadata", "namespace"), F.lit("")).alias("namespace"),
        one("spec", "replicas").alias("replicas"),
        F.transform(F.array_sort(F.collect_list(F.when(image, F.struct("line", "value")))), lambda s: s["value"]).alias("images"),
        F.min("line").alias("line"),
    )
    g = g.filter(F.col("kind").isin(*WORKLOADS, *CLOUD)).withColumn("name", F.coalesce("name", F.lower("kind")))
    work = F.col("kind").isin(*WORKLOADS)
    key = F.when(work, F.concat(F.lit("container:"), "name")).otherwise(F.concat(F.lit("cloud:kubernetes."), F.lower("kind"), F.lit(":"), "name"))
    return g.select("file", "document", "item", F.when(work, "CONTAINER").otherwise("CLOUD_RESOURCE").alias("node_type"), key.alias("natural_key"), "kind", "name", "namespace", "replicas", "images", "line")


def ci_jobs(rows: DataFrame) -> DataFrame:
    """file, document, natural_key, workflow, job, triggers, runs_on, steps (name, uses, or first line of run of each) of workflow files; one job `default` where there are none."""
    file = base_name(F.col("file"))
    r = rows.filter(F.contains(F.lower("file"), F.lit(".github/workflows/")) & (F.col("kind") != "REFUSED"))
    head = r.groupBy("file", "document").agg(F.max(F.when(_at("name"), F.col("value"))).alias("workflow"), _words(F.get("path", 0) == "on", 1).alias("triggers"))
    job = r.filter((F.get("path", 0) == "jobs") & (F.size("path") > 1))
    step = (F.get("path", 2) == "steps") & (F.size("path") == 5) & F.get("path", 4).isin("name", "uses", "run")
    told = F.struct(F.get("path", 4).alias("what"), F.substring_index("value", "\n", 1).alias("value"))
    steps = F.transform(F.array_sort(F.collect_list(F.when(step & F.col("value").isNotNull(), F.struct("line", told.alias("told"))))), lambda s: F.concat(s["told"]["what"], F.lit("="), s["told"]["value"]))
    runs = F.max(F.when((F.size("path") == 3) & (F.get("path", 2) == "runs-on"), F.col("value")))
    jobs = job.groupBy("file", "document", F.get("path", 1).alias("job")).agg(runs.alias("runs_on"), steps.alias("steps"))
    out = head.join(jobs, ["file", "document"], "left").withColumn("job", F.coalesce("job", F.lit("default")))
    key = F.concat(F.lit("ci:"), file, F.lit(":"), "job")
    return out.select("file", "document", key.alias("natural_key"), F.coalesce("workflow", file).alias("workflow"), "job", "triggers", "runs_on", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"))


#: Where settings of an application stand, nearest place first.
SETTINGS = {"datasource": (("spring", "datasource"), ("datasource",)), "redis": (("spring", "data", "redis"), ("spring", "redis"), ("redis",)), "kafka": (("spring", "kafka"), ("kafka",))}


def application_settings(rows: DataFrame) -> DataFrame:
    """file, natural_key, configured, datasource_url, redis_host of application files; of several documents the last that says something counts."""
    r = rows.filter(F.lower(base_name(F.col("file"))).rlike(r"^application.*\.ya?ml$") & (F.col("kind") != "REFUSED"))

    def under(*more: str) -> Column:
        """The value below the first of the places that a document has."""
        return lambda places: F.coalesce(*[F.max(F.when(_at(*p, *more), F.col("value"))) for p in places])

    def has(p: tuple[str, ...]) -> Column:
        return F.max(F.when(_at(*p) & ((F.col("kind") != "SCALAR") | F.col("value").isNotNull()), F.lit(True)))

    def of(setting: str, key: str) -> Column:
        """A key of the nearest place; a farther one is not asked where a nearer one is there."""
        out = F.lit(None).cast("string")
        for p in reversed(SETTINGS[setting]):
            out = F.when(has(p), under(key)((p,))).otherwise(out)
        return out

    each = r.groupBy("file", "document").agg(*[F.coalesce(*map(has, places)).alias(s) for s, places in SETTINGS.items()], of("datasource", "url").alias("url"), of("redis", "host").alias("host"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("document")))
    told = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("document", F.array_compact(F.array(*[F.when(F.col(s), s) for s in SETTINGS])).alias("c")))), lambda x: x["c"]))
    return each.groupBy("file").agg(told.alias("configured"), last("url").alias("datasource_url"), last("host").alias("redis_host"), F.collect_set("url").alias("urls")).select("file", F.concat(F.lit("config:"), "file").alias("natural_key"), "configured", "datasource_url", "redis_host", "urls")


def config_edges(services: DataFrame, settings: DataFrame) -> DataFrame:
    """source, target, edge_type, confidence: services DEPLOYED_IN what they depend on (CONFIRMED), and application files CONFIGURED_BY (POSSIBLE) the containers
    of redis, and of a database that is on this machine or named like its engine."""
    key = lambda c: F.concat(F.lit("container:"), c)
    deployed = services.select(key(F.col("service")).alias("source"), F.explode("depends_on").alias("on")).select("source", key(F.col("on")).alias("target"), F.lit("DEPLOYED_IN").alias("edge_type"), F.lit("CONFIRMED").alias("confidence"))
    form = "jdbc:([^:]+):(?://)?([^:/]+)"
    engine, host = F.regexp_extract("url", form, 1), F.regexp_extract("url", form, 2)
    service = F.when(F.lower(engine).isin("postgresql", "postgres"), "postgres").otherwise(engine)
    near = host.isin("localhost", "127.0.0.1") | (F.lower(service) == F.lower(host))
    data = settings.select("natural_key", F.explode("urls").alias("url")).filter((engine != "") & near).select("natural_key", service.alias("service"))
    redis = settings.filter(F.array_contains("configured", "redis")).select("natural_key", F.lit("redis").alias("service"))
    configured = data.unionByName(redis).select(F.col("natural_key").alias("source"), key(F.col("service")).alias("target"), F.lit("CONFIGURED_BY").alias("edge_type"), F.lit("POSSIBLE").alias("confidence"))
    return deployed.unionByName(configured).distinct()
