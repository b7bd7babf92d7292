"""Facts derived from the graph: findings, links, closures, features and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import meta_get, package_cluster, path_prefix
from quarry.operators.graph import rank, without_edge
from quarry.sources.tables import staged


def unmatched_api_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components and hooks that declare calls but consume no endpoint."""
    callers = nodes.filter(F.col("node_type").isin("COMPONENT", "HOOK") & meta_get(F.col("metadata"), "apiCalls").isNotNull())
    used = edges.filter("edge_type = 'CONSUMES'").select(F.col("source").alias("natural_key"))
    return callers.join(used, "natural_key", "left_anti")


def unmapped_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Database entities that map to no table."""
    return without_edge(nodes, edges, "DB_ENTITY", "MAPS_TO")


def route_consumes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, confidence of the CONSUMES edges that routes take over from their component: only routes that contain just one, and
    whose component is not known to be unresolved."""
    state = F.coalesce(meta_get(F.col("metadata"), "componentResolution"), F.lit("RESOLVED"))
    routes = nodes.filter((F.col("node_type") == "FE_ROUTE") & (state == "RESOLVED")).select(F.col("natural_key").alias("source"))
    components = nodes.filter("node_type = 'COMPONENT'").select(F.col("natural_key").alias("target"))
    held = edges.filter("edge_type = 'CONTAINS'").select("source", "target").join(components, "target", "left_semi").join(routes, "source", "left_semi")
    one = held.groupBy("source").agg(F.min("target").alias("component"), F.count_distinct("target").alias("n")).filter("n = 1")
    uses = edges.filter("edge_type = 'CONSUMES'").select(F.col("source").alias("component"), F.col("target"), "confidence")
    return one.select("source", "component").join(uses, "component").select("source", "target", "confidence").distinct()


def file_contains_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target): file nodes and the types declared in their file, without those already linked."""
    files = nodes.filter("node_type = 'FILE'").select("path", F.col("natural_key").alias("source"))
    types = nodes.filter(F.col("node_type").isin("CLASS", "INTERFACE", "ENUM", "ANNOTATION") & F.col("path").isNotNull()).select("path", F.col("natural_key").alias("target"))
    known = edges.filter("edge_type = 'CONTAINS'").select("source", "target")
    return files.join(types, "path").select("source", "target").join(known, ["source", "target"], "left_anti")


def conflicting_routes(routes: DataFrame) -> DataFrame:
    """Routes (route, component) with `resolution`: UNRESOLVED where a key is declared more than once, RESOLVED where it has a component."""
    n = routes.groupBy("route").agg(F.count("*").alias("n"))
    return routes.join(n, "route").select("route", "component", F.when((F.col("n") != 1) | F.col("component").isNull(), "UNRESOLVED").otherwise("RESOLVED").alias("resolution"))


def transitive_closure(pairs: DataFrame, most: int = 64) -> DataFrame:
    """(sub, super): all pairs that chains of the given ones lead to. Chains double in length each round, so few rounds are needed; cycles
    end because known pairs add nothing. A round's pairs are staged for the next."""
    known = staged(pairs.select("sub", "super").distinct())
    n = known.count()
    for _ in range(most):
        longer = known.select("sub", F.col("super").alias("mid")).join(known.select(F.col("sub").alias("mid"), "super"), "mid").select("sub", "super")
        grown = staged(known.unionByName(longer).distinct())
        more = grown.count()
        if more == n:
            break
        known, n = grown, more
    return known


def dispatch_candidates(calls: DataFrame, methods: DataFrame, supertypes: DataFrame, most: int = 5) -> DataFrame:
    """call, target, candidates of virtual calls (call, declared, receiver, name, params): the concrete methods (method, owner, name, params) of the
    receiver and its subtypes with that name and number of parameters, those with the same parameter types only where an owner has some. None or more
    than `most`: the declared method, with their number."""
    closure = transitive_closure(supertypes).unionByName(methods.select(F.col("owner").alias("sub"), F.col("owner").alias("super"))).distinct()
    m = methods.select("method", "owner", "name", F.col("params").alias("p"), F.size("params").alias("arity"))
    of = m.join(closure, m["owner"] == closure["sub"]).select("method", "owner", "name", "p", "arity", F.col("super").alias("receiver"))
    j = calls.withColumn("arity", F.size("params")).join(of, ["receiver", "name", "arity"])
    j = j.withColumn("same", F.col("p") == F.col("params"))
    has = F.max("same").over(W.partitionBy("call", "owner"))
    fit = j.withColumn("has", has).filter(~F.col("has") | F.col("same")).select("call", "method").distinct()
    n = fit.groupBy("call").agg(F.count("*").alias("candidates"))
    c = calls.select("call", "declared").join(n, "call", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    ok = F.col("candidates").between(1, most)
    return c.filter(ok).join(fit, "call").select("call", F.col("method").alias("target"), "candidates").unionByName(c.filter(~ok).select("call", F.col("declared").alias("target"), "candidates"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """importer, module, path: the file of a module, `a/b.py` before `a/b/__init__.py`; modules without a file are left out."""
    base = F.replace("module", F.lit("."), F.lit("/"))
    tries = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    j = imports.select("importer", "module", F.posexplode(tries).alias("turn", "path")).join(files.select("path").distinct(), "path")
    return j.groupBy("importer", "module").agg(F.min_by("path", "turn").alias("path"))


def purge_orphans(links: DataFrame, subjects: DataFrame, evidences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links whose subject (subject_type, subject_id) still exists, and the evidence that one of these holds."""
    kept = links.join(subjects.select("subject_type", "subject_id").distinct(), ["subject_type", "subject_id"], "left_semi")
    return kept, evidences.join(kept.select("evidence_id").distinct(), "evidence_id", "left_semi")


def focus_neighbours(edges: DataFrame, focus: DataFrame, k: int = 24) -> DataFrame:
    """focus, node, edge_type, direction: the first k neighbours of each focus in either direction, by node, type and direction."""
    f = focus.select("focus").distinct()
    out = edges.join(f, F.col("source") == F.col("focus")).select("focus", F.col("target").alias("node"), "edge_type", F.lit("OUT").alias("direction"))
    into = edges.join(f, F.col("target") == F.col("focus")).select("focus", F.col("source").alias("node"), "edge_type", F.lit("IN").alias("direction"))
    place = F.row_number().over(W.partitionBy("focus").orderBy("node", "edge_type", "direction"))
    return out.unionByName(into).distinct().withColumn("place", place).filter(F.col("place") <= k).drop("place")


def feature_seeds(endpoints: DataFrame, routes: DataFrame, types: DataFrame) -> DataFrame:
    """(kind, name, node): endpoints and routes (natural_key, path) by the first segment of their path, types by the cluster of their package."""
    by_path = lambda df, kind: df.select(F.lit(kind).alias("kind"), path_prefix(F.col("path")).alias("name"), F.col("natural_key").alias("node"))
    by_package = types.select(F.lit("PACKAGE").alias("kind"), package_cluster(F.col("natural_key")).alias("name"), F.col("natural_key").alias("node"))
    return by_path(endpoints, "ENDPOINT").unionByName(by_path(routes, "ROUTE")).unionByName(by_package).filter("name is not null").distinct()


def components_of(pairs: DataFrame, most: int = 64) -> DataFrame:
    """(id, comp): the least id that chains of pairs (a, b) lead to; pairs of an id with itself give single ids."""
    edges = staged(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = staged(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id"))
    for _ in range(most):
        # The least label among neighbours, then that label's own label: chains halve.
        near = edges.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("comp")).withColumnRenamed("a", "id")
        both = label.unionByName(near).groupBy("id").agg(F.min("comp").alias("comp"))
        new = both.alias("x").join(both.alias("y"), F.col("x.comp") == F.col("y.id")).select("x.id", F.least("x.comp", "y.comp").alias("comp"))
        new = staged(new)
        if not new.join(label, ["id", "comp"], "left_anti").head(1):
            return new
        label = new
    return label


def merge_seeds(seeds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(name, endpoint, nodes) of seeds (seed, name, endpoint, nodes: array) after merging: again and again the first pair (in order) with a
    Jaccard similarity of `threshold` or more is replaced by its union, put last. Of two names an endpoint's wins, else the lesser.

    Only seeds that share a node can ever merge (and empty ones with each other), so each connected group of seeds is merged by itself; merging is
    ordered, so it runs as a small function on the group's node sets. Groups are as large as what shares nodes."""
    import pandas as pd

    node = seeds.select("seed", F.explode_outer("nodes").alias("node")).withColumn("node", F.coalesce("node", F.lit("")))
    first = node.groupBy("node").agg(F.min("seed").alias("b"))
    group = components_of(node.join(first, "node").select(F.col("seed").alias("a"), "b")).withColumnsRenamed({"id": "seed"})

    def merged(g: pd.DataFrame) -> pd.DataFrame:
        todo = [(n, bool(e), frozenset(x)) for n, e, x in g.sort_values("seed")[["name", "endpoint", "nodes"]].itertuples(index=False)]

        def alike(x: frozenset, y: frozenset) -> bool:
            both = len(x & y)
            return both >= threshold * (len(x) + len(y) - both) if x or y else True

        def pair() -> tuple[int, int] | None:
            return next(((i, j) for i in range(len(todo)) for j in range(i + 1, len(todo)) if alike(todo[i][2], todo[j][2])), None)

        while (p := pair()) is not None:
            (n, e, x), (m, f, y) = (todo[k] for k in p)
            name = n if e and not f else m if f and not e else min(n, m)
            todo = [t for k, t in enumerate(todo) if k not in p] + [(name, e or f, x | y)]
        return pd.DataFrame({"name": [t[0] for t in todo], "endpoint": [t[1] for t in todo], "nodes": [sorted(t[2]) for t in todo]})

    return seeds.join(group, "seed").groupBy("comp").applyInPandas(merged, "name string, endpoint boolean, nodes array<string>")


def feature_links(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(feature, node, role) of seeds (feature, node): endpoints lead to the controllers that expose them, these to their methods, and calls up to
    `depth` steps on; then come the owners of methods, the data types used, the tables in an entity's file, and what consumes any of these."""
    n = nodes.select(F.col("natural_key").alias("node"), "node_type", "path", meta_get(F.col("metadata"), "layer").alias("layer"))
    of_type = lambda df, t: df.join(n.filter(F.col("node_type") == t).select("node"), "node", "left_semi")

    def step(df: DataFrame, kind: str, back: bool = False) -> DataFrame:
        a, b = ("target", "source") if back else ("source", "target")
        e = edges.filter(F.col("edge_type") == kind).select(F.col(a).alias("node"), F.col(b).alias("next"))
        return df.join(e, "node").select("feature", F.col("next").alias("node")).distinct()

    edges, n = staged(edges.select("source", "target", "edge_type")), staged(n)
    seeds = seeds.select("feature", "node").join(n.select("node"), "node", "left_semi").select("feature", "node")
    controllers = staged(step(of_type(seeds, "API_ENDPOINT"), "EXPOSES", back=True))
    reached = frontier = staged(of_type(step(controllers, "DECLARES"), "METHOD"))
    for _ in range(depth):
        frontier = staged(step(frontier, "CALLS").join(reached, ["feature", "node"], "left_anti"))
        reached = reached.unionByName(frontier)
    got = staged(seeds.unionByName(controllers).unionByName(reached).distinct())
    owners = step(of_type(got, "METHOD"), "DECLARES", back=True)
    data = n.filter((F.col("node_type") == "DB_ENTITY") | F.col("layer").isin("ENTITY", "REPOSITORY")).select("node")
    got = staged(got.unionByName(owners).unionByName(step(got, "USES_TYPE").join(data, "node", "left_semi").select("feature", "node")).distinct())
    entities = got.join(n.filter("layer = 'ENTITY' and path is not null"), "node").select("feature", "path").distinct()
    tables = n.filter("node_type = 'DB_TABLE'").select("node", "path")
    got = staged(got.unionByName(entities.join(tables, "path").select("feature", "node")).distinct())
    got = got.unionByName(step(got, "CONSUMES", back=True)).distinct()
    t, layer = F.col("node_type"), F.coalesce("layer", F.lit(""))
    role = F.when((t == "API_ENDPOINT") | (layer == "CONTROLLER"), "API").when(t.isin("FE_ROUTE", "COMPONENT", "HOOK", "STORE"), "UI").when(layer == "SERVICE", "SERVICE").when(layer.isin("REPOSITORY", "ENTITY") | (t == "DB_ENTITY"), "DATA")
    return got.join(n, "node").select("feature", "node", role.alias("role")).filter("role is not null")


def backend_flows(nodes: DataFrame, edges: DataFrame, depth: int = 5, most: int = 25, only: DataFrame | None = None) -> DataFrame:
    """(flow, seq, node): an endpoint, then for each controller that exposes it the controller, its handler (the method that the endpoint
    names), and what calls and reads lead to, breadth first up to `depth` steps; repositories and entities lead no further. The endpoint and the first
    `most` others. `only`: the endpoints (flow) that are asked for.

    The order of a breadth-first walk is (depth, order of the node that leads on, edge type, target), carried along as one sortable text; a
    node counts where it comes first."""
    n = nodes.select(F.col("natural_key").alias("node"), "node_type", meta_get(F.col("metadata"), "layer").alias("layer"), meta_get(F.col("metadata"), "handlerKey").alias("handler"))
    ends = n.filter("node_type = 'API_ENDPOINT'").select(F.col("node").alias("flow"), "handler")
    ends = ends if only is None else ends.join(only, "flow", "left_semi")
    by = edges.filter("edge_type = 'EXPOSES'").select(F.col("target").alias("flow"), F.col("source").alias("controller")).distinct().join(ends, "flow")
    declared = edges.filter("edge_type = 'DECLARES'").select(F.col("source").alias("controller"), F.col("target").alias("node")).distinct()
    level = by.join(declared, "controller").filter(F.col("node") == F.col("handler")).join(n.filter("node_type = 'METHOD'").select("node"), "node", "left_semi")
    level = level.select("flow", "controller", "node", F.lit("").alias("order"))
    level = staged(level)
    out = level.withColumn("depth", F.lit(0))
    leads = n.filter(F.coalesce(F.col("layer") != "REPOSITORY", F.lit(True)) & (F.col("node_type") != "DB_ENTITY")).select("node")
    e = edges.filter(F.col("edge_type").isin("CALLS", "READS_WRITES")).select(F.col("source").alias("node"), F.col("target").alias("next"), "edge_type")
    e, leads = staged(e), staged(leads)
    for d in range(1, depth + 1):
        to = level.join(leads, "node", "left_semi").join(e, "node")
        order = F.concat("order", F.lit("\u0001"), "edge_type", F.lit("\u0002"), "next")
        level = to.groupBy("flow", "controller", F.col("next").alias("node")).agg(F.min(order).alias("order"))
        level = staged(level.join(out.select("flow", "controller", "node"), ["flow", "controller", "node"], "left_anti"))
        out = out.unionByName(level.withColumn("depth", F.lit(d)))
    heads = by.select("flow", "controller", F.col("controller").alias("node"), F.lit("").alias("order"), F.lit(-1).alias("depth"))
    steps = heads.unionByName(out.select("flow", "controller", "node", "order", "depth"))
    # Of a node that several controllers lead to, the first place counts.
    once = steps.groupBy("flow", "node").agg(F.min(F.struct("controller", "depth", "order")).alias("at")).join(n.select("node"), "node", "left_semi")
    seq = F.row_number().over(W.partitionBy("flow").orderBy("at", "node"))
    once = once.withColumn("seq", seq).filter(F.col("seq") <= most).select("flow", (F.col("seq") + 1).alias("seq"), "node")
    return ends.select("flow", F.lit(1).alias("seq"), F.col("flow").alias("node")).unionByName(once)


def _numbered(steps: DataFrame, kind: str, *order: Column) -> DataFrame:
    """The steps of flows with two steps or more, numbered from 1."""
    w = W.partitionBy("flow")
    s = steps.withColumn("seq", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w)).filter("n > 1")
    return s.select(F.lit(kind).alias("kind"), "flow", "seq", "node", "edge_type", "description")


def fe_be_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (FE_BE), flow, seq, node, edge_type, description: from each front-end route its components, the last by key in front, then what it consumes by key,
    each with its back-end steps. A node that is both consumed and contained is only consumed. Routes with neither have no flow.

    A step that an edge leads to carries the edge's type. Jobs run while it is built: what routes lead to and the back-end steps are written."""
    n = nodes.select(F.col("natural_key").alias("node"), "node_type", "name")
    routes = n.filter("node_type = 'FE_ROUTE'").select(F.col("node").alias("flow"), F.col("name").alias("route"))
    out = edges.filter(F.col("edge_type").isin("CONSUMES", "CONTAINS") & (F.col("source") != F.col("target"))).select(F.col("source").alias("flow"), F.col("target").alias("node"), "edge_type").distinct()
    out = staged(out.join(routes, "flow", "left_semi").join(n, "node"))
    consumed = out.filter("edge_type = 'CONSUMES'")
    inside = out.filter("edge_type = 'CONTAINS' and node_type = 'COMPONENT'").join(consumed, ["flow", "node"], "left_anti")
    back = staged(backend_flows(nodes, edges, only=consumed.select(F.col("node").alias("flow")).distinct())).select(F.col("flow").alias("of"), F.col("seq").alias("part"), "node")
    own = consumed.select(F.col("node").alias("of")).distinct().join(back.select("of").distinct(), "of", "left_anti").select("of", F.lit(1).alias("part"), F.col("of").alias("node"))
    back = staged(back.unionByName(own).join(n.select("node", "name"), "node"))
    none = F.lit(None).cast("string")
    steps = routes.select("flow", F.lit(0).alias("block"), F.lit("").alias("of"), F.lit(0).alias("part"), F.col("flow").alias("node"), none.alias("edge_type"), F.concat(F.lit("Route "), "route").alias("description"))
    steps = steps.unionByName(inside.select("flow", F.lit(1).alias("block"), F.col("node").alias("of"), F.lit(0).alias("part"), "node", "edge_type", F.col("name").alias("description")))
    steps = steps.unionByName(consumed.select("flow", F.lit(2).alias("block"), F.col("node").alias("of"), F.lit(0).alias("part"), "node", "edge_type", F.concat(F.lit("CONSUMES "), "name").alias("description")))
    behind = consumed.select("flow", F.col("node").alias("of")).join(back, "of")
    steps = steps.unionByName(behind.select("flow", F.lit(2).alias("block"), "of", "part", "node", none.alias("edge_type"), F.col("name").alias("description")))
    return _numbered(steps, "FE_BE", F.col("block"), F.when(F.col("block") == 1, F.col("of")).desc(), F.col("of"), F.col("part"))


def _around(nodes: DataFrame, edges: DataFrame, kind: str, types: tuple[str, ...], near: str, far: str) -> tuple[DataFrame, DataFrame]:
    """(centres, neighbours) of nodes of a kind: (flow, name), and (flow, node, edge_type, description) along edges of the types."""
    n = nodes.select(F.col("natural_key").alias("node"), "node_type", "name")
    centres = n.filter(F.col("node_type") == kind).select(F.col("node").alias("flow"), "name")
    e = edges.filter(F.col("edge_type").isin(*types)).select(F.col(near).alias("flow"), F.col(far).alias("node"), "edge_type").distinct()
    e = e.join(centres.select("flow"), "flow", "left_semi").join(n.select("node", "name"), "node")
    return centres, e.select("flow", "node", "edge_type", F.concat("edge_type", F.lit(" "), "name").alias("description"))


def infra_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (INFRA), flow, seq, node, edge_type, description: each container, then what it is deployed in by key; containers that are deployed nowhere have no flow."""
    centres, to = _around(nodes, edges, "CONTAINER", ("DEPLOYED_IN",), "source", "target")
    head = centres.select("flow", F.lit(0).alias("block"), F.col("flow").alias("node"), F.lit(None).cast("string").alias("edge_type"), F.col("name").alias("description"))
    return _numbered(head.unionByName(to.withColumn("block", F.lit(1))), "INFRA", F.col("block"), F.col("node"))


def event_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (EVENT), flow, seq, node, edge_type, description: what publishes to a topic, what subscribes to it, by key, then the topic; a topic that nothing touches has
    no flow."""
    centres, to = _around(nodes, edges, "QUEUE_TOPIC", ("PUBLISHES", "SUBSCRIBES"), "target", "source")
    tail = centres.select("flow", F.lit(1).alias("block"), F.col("flow").alias("node"), F.lit(None).cast("string").alias("edge_type"), F.col("name").alias("description"))
    return _numbered(tail.unionByName(to.withColumn("block", F.lit(0))), "EVENT", F.col("block"), F.col("edge_type"), F.col("node"))


#: Edge types that lead from a step to a later one, and those that lead back.
FORWARD, REVERSE = ("CONSUMES", "CONTAINS", "DECLARES", "CALLS", "READS_WRITES", "DEPLOYED_IN"), ("EXPOSES",)


def step_verdicts(steps: DataFrame, edges: DataFrame, forward: tuple[str, ...] = FORWARD, reverse: tuple[str, ...] = REVERSE) -> DataFrame:
    """flow, seq, node, entry, edge_type, confidence of flow steps (flow, seq, node, entry_node, edge_id).

    A step takes the verdict of its recorded edge. Of the others, the first of the entry node is the anchor and has none; the rest, and steps whose recorded
    edge is gone, take the strongest edge (of equals the least id) that leads to them from an earlier step, or back along a reverse type."""
    first = steps.filter((F.col("node") == F.col("entry_node")) & F.col("edge_id").isNull()).groupBy("flow").agg(F.min("seq").alias("anchor"))
    s = steps.join(first, "flow", "left").withColumn("entry", F.coalesce(F.col("seq") == F.col("anchor"), F.lit(False)))
    e = edges.select("edge_id", "source", "target", "edge_type", "confidence")
    s = s.join(e.select("edge_id", F.struct("edge_type", "confidence").alias("own")), "edge_id", "left")
    ahead = e.filter(F.col("edge_type").isin(*forward)).select("edge_id", F.col("source").alias("from"), F.col("target").alias("node"), "edge_type", "confidence")
    back = e.filter(F.col("edge_type").isin(*reverse)).select("edge_id", F.col("target").alias("from"), F.col("source").alias("node"), "edge_type", "confidence")
    # Of the edges between two nodes only the strongest can count.
    order = F.struct(rank(F.col("confidence")), -F.col("edge_id"))
    links = ahead.unionByName(back).groupBy("from", "node").agg(F.max_by(F.struct("edge_id", "edge_type", "confidence"), order).alias("l")).select("from", "node", "l.*")
    to = s.filter("not entry and own is null").select("flow", "seq", "node").join(links, "node")
    earlier = steps.groupBy("flow", F.col("node").alias("from")).agg(F.min("seq").alias("before"))
    to = to.join(earlier, ["flow", "from"]).filter("before < seq")
    best = to.groupBy("flow", "seq").agg(F.max_by(F.struct("edge_type", "confidence"), order).alias("v"))
    s = s.select("flow", "seq", "node", "entry", "own").join(best, ["flow", "seq"], "left").withColumn("v", F.coalesce("own", "v"))
    return s.select("flow", "seq", "node", "entry", "v.edge_type", "v.confidence")


def process_tree_rss(rows: DataFrame, most: int = 64) -> DataFrame:
    """sample, owner, rss_kib: the memory of the owner, of the processes scoped to it, and of all below these, at each sample (sample, owner, pid,
    ppid, rss_kib, scope_owner). Samples without the owner have no total."""
    has = rows.filter(F.col("pid") == F.col("owner")).select("sample", "owner").distinct()
    r = rows.join(has, ["sample", "owner"], "left_semi")
    got = r.filter((F.col("pid") == F.col("owner")) | F.coalesce(F.col("scope_owner") == F.col("owner"), F.lit(False))).select("sample", "owner", "pid").distinct()
    frontier = got = staged(got)
    r = staged(r)
    for _ in range(most):
        below = r.select("sample", "owner", "pid", "ppid").join(frontier.select("sample", "owner", F.col("pid").alias("ppid")), ["sample", "owner", "ppid"]).select("sample", "owner", "pid").distinct()
        frontier = staged(below.join(got, ["sample", "owner", "pid"], "left_anti"))
        if not frontier.head(1):
            break
        got = got.unionByName(frontier)
    return r.join(got, ["sample", "owner", "pid"], "left_semi").groupBy("sample", "owner").agg(F.sum("rss_kib").alias("rss_kib"))


def graph_to_observations(edges: DataFrame, most: int = 5) -> DataFrame:
    """cell, relation, path, span, resolution, targets, oversized: confirmed edges (cell, edge_type, path, span, target, confidence) are facts of
    one target each; the others of a place are one set of candidates, in order, marked where it is too large."""
    facts = edges.filter("confidence = 'CONFIRMED'").select("cell", F.col("edge_type").alias("relation"), "path", "span", F.lit("FACT").alias("resolution"), F.array("target").alias("targets")).distinct()
    rest = edges.filter("confidence <> 'CONFIRMED'").groupBy("cell", F.col("edge_type").alias("relation"), "path", "span").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    both = facts.unionByName(rest.select("cell", "relation", "path", "span", F.lit("CANDIDATES").alias("resolution"), "targets"))
    return both.withColumn("oversized", F.size("targets") > most).withColumn("targets", F.array_join("targets", ","))


def layer_of(annotations: Column, extended: Column) -> Column:
    """Layer of a class by its annotations and the types it extends; null without any that tells."""
    has = lambda *names: F.arrays_overlap(annotations, F.array(*map(F.lit, names)))
    stores = F.exists(extended, lambda s: s.isin("CrudRepository", "PagingAndSortingRepository", "ListCrudRepository") | s.endswith("JpaRepository"))
    layer = F.when(has("RestController", "Controller"), "CONTROLLER").when(has("Service"), "SERVICE").when(has("Repository") | stores, "REPOSITORY")
    return layer.when(has("Entity"), "ENTITY").when(has("Configuration", "SpringBootApplication"), "CONFIG")
