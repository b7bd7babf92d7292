"""Tables from the texts of build, infrastructure and source files. Each takes (path, text); null texts hold nothing."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import base_name

NAME = r"[A-Za-z0-9_.\-]+"
#: The sections of a package manifest that declare dependencies.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def _groups(text: Column, form: str, names: list[str]) -> Column:
    """An array of structs: the groups of each match of an expression."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(form), F.lit(i + 1)) for i in range(len(names))]
    return F.arrays_zip(*[c.alias(n) for c, n in zip(found, names)])


def extract_dependencies(files: DataFrame) -> DataFrame:
    """path, scope, dependency, version of Gradle, Maven and package manifests; null versions are unknown."""
    name = base_name(F.col("path"))
    gradle = files.filter(name.rlike(r"\.gradle(\.kts)?$"))
    form = rf"(?m)^\s*([A-Za-z]+)[ (]+[\"']({NAME}:{NAME})(?::([^\"'@]+))?[\"']"
    gradle = gradle.select("path", F.explode(_groups(F.col("text"), form, ["scope", "dependency", "version"])).alias("d")).select("path", "d.*")
    blocks = files.filter(name == "pom.xml").select("path", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("b"))
    of = lambda t: F.trim(F.regexp_extract("b", f"<{t}>([^<]*)</{t}>", 1))
    maven = blocks.select("path", F.coalesce(F.nullif(of("scope"), F.lit("")), F.lit("compile")).alias("scope"), F.concat(of("groupId"), F.lit(":"), of("artifactId")).alias("dependency"), of("version").alias("version"))
    sections = F.array(*[F.struct(F.lit(s).alias("scope"), F.from_json(F.get_json_object("text", f"$.{s}"), "map<string,string>").alias("m")) for s in SECTIONS])
    node = files.filter(name == "package.json").select("path", F.explode(sections).alias("s")).select("path", "s.scope", F.explode("s.m").alias("dependency", "version"))
    out = gradle.unionByName(maven).unionByName(node)
    return out.select("path", "scope", "dependency", F.nullif("version", F.lit("")).alias("version"))


def extract_terraform(files: DataFrame) -> DataFrame:
    """path, kind, name of resources."""
    found = _groups(F.col("text"), rf"(?m)^\s*resource\s+\"({NAME})\"\s+\"({NAME})\"\s*\{{", ["kind", "name"])
    return files.filter(F.lower("path").endswith(".tf")).select("path", F.explode(found).alias("r")).select("path", "r.*")


def extract_dockerfiles(files: DataFrame) -> DataFrame:
    """path, place, instruction, argument of FROM, EXPOSE and CMD; continued lines are joined, comments left out."""
    t = F.regexp_replace(F.regexp_replace(F.col("text"), r"(?m)^[ \t]*#.*(\r?\n|$)", ""), r"\\[ \t]*\r?\n", " ")
    lines = files.filter(F.lower(base_name(F.col("path"))).rlike(r"^dockerfile(\.|$)")).select("path", F.posexplode(F.split(t, r"\r?\n")).alias("place", "line"))
    form = r"(?i)^\s*(FROM|EXPOSE|CMD)\s+(.*?)\s*$"
    out = lines.select("path", "place", F.upper(F.regexp_extract("line", form, 1)).alias("instruction"), F.regexp_extract("line", form, 2).alias("argument"))
    return out.filter("instruction <> ''")


def resolve_dockerfiles(services: DataFrame, dockerfiles: DataFrame) -> DataFrame:
    """service, path of services (service, compose_path, context, dockerfile): the file that build context and name lead to from the compose
    file's folder, `.` and `..` resolved; services without such a file are left out."""
    folder = F.regexp_replace("compose_path", "[^/]*$", "")
    whole = F.concat(folder, F.coalesce("context", F.lit(".")), F.lit("/"), F.coalesce("dockerfile", F.lit("Dockerfile")))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    step = lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return services.select("service", path.alias("path")).join(dockerfiles.select("path").distinct(), "path", "left_semi")


def _python_facts(text: str) -> list[tuple[str, str, int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("UNPARSED", "", 0)]
    out, todo = [], [(tree, "")]
    while todo:
        node, owner = todo.pop()
        for n in ast.iter_child_nodes(node):
            name = owner
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}{n.name}"
                out.append(("CLASS" if isinstance(n, ast.ClassDef) else "FUNCTION", name, n.lineno))
                name += "."
            elif isinstance(n, ast.Import):
                out += [("IMPORT", a.name, n.lineno) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out.append(("IMPORT", "." * n.level + (n.module or ""), n.lineno))
            todo.append((n, name))
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def extract_python(files: DataFrame) -> DataFrame:
    """path, kind, name, line of classes, functions and imports of Python files; a file that cannot be parsed gives one UNPARSED row. Parsing a file
    needs the whole of it, so it runs on Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *f) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in _python_facts(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=["path", "kind", "name", "line"])

    return files.filter(F.col("path").endswith(".py")).select("path", "text").mapInArrow(run, "path string, kind string, name string, line int")
