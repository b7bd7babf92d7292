"""Lists, views and search over the tables of a snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import contains_ci, meta_get, text_match, trigram_similarity

#: Node types of the categories of a listing.
SYMBOLS = "METHOD CLASS INTERFACE ENUM ANNOTATION FIELD COMPONENT HOOK STORE CONTROLLER SERVICE REPOSITORY ENTITY DB_ENTITY FUNCTION".split()
CATEGORIES = {
    "symbols": lambda: F.col("node_type").isin(*SYMBOLS),
    "entrypoints": lambda: F.col("node_type").isin("API_ENDPOINT", "FE_ROUTE"),
    "dependencies": lambda: (F.col("node_type") == "CONFIG") & F.startswith("natural_key", F.lit("dep:")),
}
SORTS = {
    "": lambda: [F.col("natural_key")],
    "name": lambda: [F.col("name"), F.col("natural_key")],
    "path": lambda: [F.asc_nulls_last("path"), F.asc_nulls_last("line_start"), F.col("natural_key")],
    "type": lambda: [F.col("node_type"), F.col("natural_key")],
}
MOST = 100


def list_nodes(nodes: DataFrame, node_type: str | None = None, area: str | None = None, q: str | None = None, path: str | None = None, category: str | None = None) -> DataFrame:
    """Nodes (natural_key, node_type, name, path, line_start, area_type) that all given conditions hold for, none ambiguous. `q` is part of the
    name, key or path in any case; `path` is the node's file or the file itself."""
    tests = [F.col("node_type") != "AMBIGUOUS"]
    tests += [F.col("node_type") == node_type] if node_type else []
    tests += [F.col("area_type") == area] if area else []
    tests += [(F.col("path") == path) | (F.col("natural_key") == f"file:{path}")] if path else []
    tests += [contains_ci(F.col("name"), q) | contains_ci(F.col("natural_key"), q) | F.coalesce(contains_ci(F.col("path"), q), F.lit(False))] if q else []
    tests += [CATEGORIES[category]()] if category else []
    return nodes.filter(reduce(lambda a, b: a & b, tests))


def sort_nodes(nodes: DataFrame, sort: str = "", page: int = 0, size: int = MOST) -> DataFrame:
    """A page of up to MOST nodes by name, path, type or key."""
    size = min(size, MOST)
    return nodes.orderBy(*SORTS[sort]()).offset(page * size).limit(size)


def extract_endpoints(nodes: DataFrame) -> DataFrame:
    """natural_key, http_method, path, handler_key of the endpoints that have all three."""
    m = [meta_get(F.col("metadata"), k).alias(a) for k, a in (("httpMethod", "http_method"), ("path", "path"), ("handlerKey", "handler_key"))]
    return nodes.filter("node_type = 'API_ENDPOINT'").select("natural_key", *m).dropna(subset=["http_method", "path", "handler_key"])


def extract_entities(nodes: DataFrame) -> DataFrame:
    """natural_key, entity_name, table_name, source of database entities, their name and JPA where nothing else is known."""
    known = lambda k, other: F.coalesce(meta_get(F.col("metadata"), k), other)
    return nodes.filter("node_type = 'DB_ENTITY'").select("natural_key", known("entityName", F.col("name")).alias("entity_name"), known("tableName", F.col("name")).alias("table_name"), known("source", F.lit("JPA")).alias("source"))


def extract_routes(nodes: DataFrame) -> DataFrame:
    """natural_key, path, component_key of the routes with a path."""
    return nodes.filter("node_type = 'FE_ROUTE'").select("natural_key", meta_get(F.col("metadata"), "path").alias("path"), meta_get(F.col("metadata"), "componentKey").alias("component_key")).dropna(subset=["path"])


KINDS = {"CI_PIPELINE": "CI", "CLOUD_RESOURCE": "CLOUD", "CONTAINER": "CONTAINER"}


def extract_infra(nodes: DataFrame) -> DataFrame:
    """natural_key, kind, name, source_path of containers, pipelines and cloud resources."""
    kind = F.col("node_type")
    for k, v in KINDS.items():
        kind = F.when(F.col("node_type") == k, v).otherwise(kind)
    return nodes.filter(F.col("node_type").isin(*KINDS)).select("natural_key", kind.alias("kind"), "name", F.col("path").alias("source_path"))


def frontend_layer(node_type: Column, metadata: Column) -> Column:
    """PAGE, STATE, API_CLIENT or COMPONENT; null for nodes that are not the front end's."""
    layer = F.when(node_type == "FE_ROUTE", "PAGE").when(node_type.isin("STORE", "HOOK"), "STATE").when(meta_get(metadata, "apiCalls").isNotNull(), "API_CLIENT").otherwise("COMPONENT")
    return F.when(node_type.isin("FE_ROUTE", "COMPONENT", "HOOK", "STORE"), layer)


LAYERS = ("CONTROLLER", "SERVICE", "REPOSITORY", "ENTITY")


def backend_view(nodes: DataFrame) -> DataFrame:
    """layer, natural_key, name of the own (not external) nodes of a back-end layer."""
    layer = meta_get(F.col("metadata"), "layer")
    own = F.coalesce(meta_get(F.col("metadata"), "external"), F.lit("false")) != "true"
    return nodes.filter(layer.isin(*LAYERS) & own).select(layer.alias("layer"), "natural_key", "name")


def layer_call_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_group, target_group, n of calls between methods of the layers that declare them. A method's layers come first, in one
    small table by method; each call then meets it twice."""
    layer = meta_get(F.col("metadata"), "layer")
    owners = nodes.filter(layer.isin(*LAYERS)).select(F.col("natural_key").alias("source"), layer.alias("layer"))
    of = edges.filter("edge_type = 'DECLARES'").join(owners, "source").groupBy("target", "layer").agg(F.count("*").alias("k"))
    calls = edges.filter("edge_type = 'CALLS'").select("source", "target")
    x = calls.join(of.select(F.col("target").alias("source"), F.col("layer").alias("source_group"), F.col("k").alias("a")), "source")
    x = x.join(of.select("target", F.col("layer").alias("target_group"), F.col("k").alias("b")), "target")
    return x.groupBy("source_group", "target_group").agg(F.sum(F.col("a") * F.col("b")).alias("n"))


SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM")


def severity_rank(severity: Column) -> Column:
    """1 for the worst; what is not in SEVERITIES comes last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)), F.lit(4))


def list_findings(findings: DataFrame, severity: str | None = None) -> DataFrame:
    """Findings, worst first, then by category, title, id; `place` numbers them within their snapshot."""
    f = findings if severity is None else findings.filter(F.col("severity") == severity)
    return f.orderBy("snapshot_id", severity_rank(F.col("severity")), "category", "title", "id")


STATUSES = ("OPEN", "DRAFT", "DONE")


def list_tasks(tasks: DataFrame, include_drafts: bool = False, k: int | None = None) -> DataFrame:
    """Tasks but for learning ones (and drafts, unless asked for): open, draft, done, others; the newest first. The first k of each project, or all."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), F.lit(0)), F.lit(4))
    t = tasks.filter("type <> 'LEARNING'")
    t = t if include_drafts else t.filter("status <> 'DRAFT'")
    order = [rank, F.desc_nulls_first("updated_at"), F.desc("id")]
    if k is None:
        return t.orderBy("project_id", *order)
    return t.withColumn("place", F.row_number().over(W.partitionBy("project_id").orderBy(*order))).filter(F.col("place") <= k)


def visible_changes(changes: DataFrame, k: int = 100) -> DataFrame:
    """snapshot_id, line: the first k changes of each snapshot by path, each as its letter (A, M, D) and path."""
    letter = F.when(F.col("change") == "ADDED", "A").when(F.col("change") == "REMOVED", "D").otherwise("M")
    w = W.partitionBy("snapshot_id").orderBy("path")
    return changes.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("snapshot_id", F.concat(letter, F.lit(" "), "path").alias("line"))


PER_TYPE = 8
#: What each entity is searched by: the column of its title, those whose parts match in any case, those whose words match, and whether its
#: rows are in a snapshot, of which only each project's current one counts.
SEARCHED = {
    "FILE": ("path", ["path"], ["path"], True),
    "SYMBOL": ("name", ["name"], ["name"], True),
    "FEATURE": ("name", ["name"], ["name", "description"], True),
    "FLOW": ("name", ["name"], ["name"], True),
    "FINDING": ("title", ["title"], ["title", "detail"], True),
    "COMMIT": ("sha", ["sha", "message"], ["message"], False),
    "PR": ("title", ["title"], ["title"], False),
    "NOTE": ("title", ["title", "content_md"], ["title", "content_md"], False),
    "TASK": ("title", ["title", "description"], ["title", "description"], False),
    "EVIDENCE": ("file_path", ["file_path", "excerpt"], [], False),
}
#: Hidden from search: structure among symbols, drafts and learning among tasks.
HIDDEN = {"SYMBOL": "node_type not in ('FILE', 'DIRECTORY')", "TASK": "status <> 'DRAFT' and type <> 'LEARNING'"}


def _order(kind: str, query: str) -> list[Column]:
    if kind in ("FILE", "SYMBOL"):
        return [F.desc(trigram_similarity(F.col(SEARCHED[kind][0]), F.lit(query))), F.col("id")]
    by = {"COMMIT": F.desc_nulls_last("committed_at"), "PR": F.desc("number"), "NOTE": F.desc("updated_at"), "TASK": F.desc("updated_at"), "EVIDENCE": F.desc("id")}
    return [by[kind], F.col("id")] if kind in by else [F.col("id")]


def search(tables: dict[str, DataFrame], projects: DataFrame, query: str, user_id: int, project_id: int | None = None, k: int = PER_TYPE) -> DataFrame:
    """type, project_id, id, title, place: the first k hits of each entity in the user's projects (id, user_id, current_snapshot_id).

    A hit has the query as a part, in any case, or all its words. Each entity is filtered before similarity is computed, and its first k are
    found by partial sorts. Only a project's current snapshot is searched. A blank query is refused."""
    if not query.strip():
        raise ValueError("a blank query finds nothing")
    mine = projects.filter(F.col("user_id") == user_id)
    mine = mine if project_id is None else mine.filter(F.col("id") == project_id)
    out = []
    for kind, df in tables.items():
        title, parts, words, in_snapshot = SEARCHED[kind]
        tests = [F.coalesce(contains_ci(F.col(c), query), F.lit(False)) for c in parts]
        tests += [text_match(F.concat_ws(" ", *words), query)] if words else []
        hits = df.filter(reduce(lambda a, b: a | b, tests))
        hits = hits.filter(HIDDEN[kind]) if kind in HIDDEN else hits
        if in_snapshot:
            hits = hits.join(mine.select(F.col("current_snapshot_id").alias("snapshot_id"), F.col("id").alias("_project")), "snapshot_id")
        else:
            hits = hits.join(mine.select(F.col("id").alias("project_id")), "project_id").withColumn("_project", F.col("project_id"))
        order = [*_order(kind, query), F.col("_project")]
        first = hits.orderBy(*order).limit(k)
        first = first.withColumn("place", F.row_number().over(W.orderBy(*order)))  # of k rows at most
        out.append(first.select(F.lit(kind).alias("type"), F.col("_project").alias("project_id"), "id", F.col(title).alias("title"), "place"))
    return reduce(DataFrame.unionByName, out)
