"""SQL migrations: their statements, and the tables that are left once all of them have run in order.

Files are read one by one into events of a table. Events are ordered by the file's version and put together by table: every table's history is folded
alone, event by event in sorted partitions, so there is no group of all files. A renamed table takes its history along: a name's events are cut into lives where a
rename brings a table in or takes it away, lives are linked by the renames, and all lives of one table are folded together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions.text import base_name
from quarry.sources.tables import staged

#: Folders of migrations and the form of a versioned file's name.
FOLDERS = ("db/migration", "db/changelog", "/liquibase/", "supabase/migrations", "/migrations/")
VERSIONED = r"(?i)^V(\d+(?:[._]\d+)*)__.*\.sql$"
#: What a scanner passes over as one piece; a dollar quote ends with its own tag. An opening alone is an error.
PIECE = re.compile(r"--[^\n]*|/\*.*?\*/|'[^']*'|\"[^\"]*\"|`[^`]*`|(\$\w*\$).*?\1|;|[^-/'\"`$;]+|.", re.S)
NAME = r"(?:\"[^\"]+\"|`[^`]+`|\[[^\]]+\]|[\w$]+)"
TABLE = rf"((?:{NAME}\s*\.\s*)*{NAME})"
CREATE = re.compile(rf"create\s+(?:(?:global|local)\s+)?(?:temp(?:orary)?\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?{TABLE}\s*(\(.*|as\s.*)?$", re.I | re.S)
ALTER = re.compile(rf"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{TABLE}\s+(.*)$", re.I | re.S)
DROP = re.compile(r"drop\s+table\s+(?:if\s+exists\s+)?(.*?)(?:\s+(?:cascade|restrict))?\s*$", re.I | re.S)
INDEX = re.compile(rf"create\s+(?:unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?({NAME})?\s*on\s+(?:only\s+)?{TABLE}", re.I | re.S)
RENAME_TABLE = re.compile(rf"rename\s+to\s+{TABLE}$", re.I)
RENAME_COLUMN = re.compile(rf"rename\s+(?:column\s+)?({NAME})\s+to\s+({NAME})$", re.I)
DROP_COLUMN = re.compile(rf"drop\s+(?:column\s+)?(?:if\s+exists\s+)?({NAME})(?:\s+(?:cascade|restrict))?$", re.I)
ADD_COLUMN = re.compile(r"(?:add|modify)\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?(.*)$", re.I | re.S)
ALTER_COLUMN = re.compile(rf"alter\s+(?:column\s+)?({NAME}\s+(?:set\s+data\s+)?type\s+.*)$", re.I | re.S)
SET_TYPE = re.compile(rf"^({NAME})\s+(?:set\s+data\s+)?type\s+", re.I)
DEFINED = re.compile(rf"({NAME})\s+(.*)$", re.S)
NAMES, WORD, ARGUMENTS, MORE, MARKS = re.compile(NAME), re.compile(r"\s*([\w.\"]+)"), re.compile(r"\s*\(([^()]*)\)"), re.compile(r"\s+(\w+)"), re.compile(r"\s*(\[\d*\])")
#: What commas and brackets part a list into; runs without any of them are one piece.
PART = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`|[^'\"`(),]+|.", re.S)
#: Words that begin a constraint and no column; words that a type may consist of besides its first.
CONSTRAINTS = ("constraint", "primary", "foreign", "unique", "check", "exclude", "like", "key", "index")
TYPE_WORDS = ("precision", "varying", "with", "without", "time", "zone", "unsigned", "local", "large", "object")
EVENT = "statement int, item int, kind string, table string, name string, value string, line_start int, line_end int, line int"


def is_migration(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    place = F.lit(False)
    for folder in FOLDERS:
        place = place | F.contains(p, F.lit(folder))
    return p.endswith(".sql") & (place | base_name(p).rlike(VERSIONED))


def version_key(path: Column) -> Column:
    """What files are ordered by: versions as numbers, part by part; files without a version come after them, by path."""
    version = F.regexp_extract(base_name(path), VERSIONED, 1)
    padded = F.array_join(F.transform(F.split(version, "[._]"), lambda p: F.lpad(p, 10, "0")), "")
    return F.when(version != "", F.concat(F.lit("0:"), padded)).otherwise(F.concat(F.lit("1:"), path))


def bare(name: str) -> str:
    """The last part of a name, without quotes."""
    last = NAMES.findall(name)[-1]
    return last[1:-1] if last[0] in "\"`[" else last


def statements(text: str) -> list[tuple[str, int, int]]:
    """(statement without comments, first line, last line) of a script; lines count from 1. Raises ValueError where a quote or comment is not closed."""
    out, now, line, first, last = [], [], 1, 0, 0
    for m in PIECE.finditer(text + ";"):
        x = m[0]
        if x == ";":
            if first:
                out.append(("".join(now).strip(), first, last))
            now, first = [], 0
        elif x in "'\"`" or x == "/" and text.startswith("/*", m.start()):
            raise ValueError("a quote or comment is not closed")
        elif x.startswith(("--", "/*")):
            now.append(" ")
        else:
            now.append(x)
            body = x.strip()
            if body:
                at = line + x[: x.index(body)].count("\n")
                first, last = first or at, at + body.count("\n")
        line += x.count("\n")
    return out


def items(body: str, inside: bool = False) -> list[str]:
    """What commas outside brackets and quotes part; `inside`: up to the closing bracket, which must come."""
    out, depth, now = [], 0, []
    for x in PART.findall(body):
        depth += (x == "(") - (x == ")")
        if depth < 0:
            break
        if x == "," and not depth:
            out.append("".join(now))
            now = []
        else:
            now.append(x)
    if depth != -inside:
        raise ValueError("a bracket is not closed")
    return [i.strip() for i in [*out, "".join(now)] if i.strip()]


def type_of(rest: str) -> str | None:
    """The type at the start of a column's definition: its words, arguments in brackets, array marks."""
    m = WORD.match(rest)
    if not m:
        return None
    words, at = [m[1]], m.end()
    while True:
        if m := ARGUMENTS.match(rest, at):
            words.append("(" + ", ".join(a.strip() for a in m[1].split(",")) + ")")
        elif (m := MORE.match(rest, at)) and m[1].lower() in TYPE_WORDS:
            words.append(m[1])
        elif m := MARKS.match(rest, at):
            words[-1] += m[1]
        else:
            return " ".join(words)
        at = m.end()


def column(item: str) -> tuple[str, str] | None:
    m = DEFINED.match(item)
    if not m or m[1].lower() in CONSTRAINTS:
        return None
    kind = type_of(m[2])
    return (bare(m[1]), kind) if kind else None


def column_line(lines: list[str], first: int, last: int, name: str) -> int | None:
    """The only line of a statement that begins with a column's name; null where there are none or several."""
    form = re.compile(rf"\s*[\"`\[]?{re.escape(name)}[^\w]", re.I)
    at = [n for n in range(first, min(last, len(lines)) + 1) if form.match(lines[n - 1])]
    return at[0] if len(at) == 1 else None


def events_of(text: str) -> list[tuple]:
    """EVENT rows of a script."""
    out, lines, parted = [], None, statements(text)
    for k, (s, first, last) in enumerate(parted):
        made: list[tuple] = []
        if m := CREATE.match(s):
            made.append(("CREATE", bare(m[1]), None, None, None))
            lines = text.splitlines() if lines is None else lines
            made += [] if not (m[2] or "").startswith("(") else [("ADD", bare(m[1]), *c, column_line(lines, first, last, c[0])) for i in items(m[2][1:], True) if (c := column(i))]
        elif m := ALTER.match(s):
            t = bare(m[1])
            made.append(("TOUCH", t, None, None, None))
            for a in items(m[2]):
                if r := RENAME_TABLE.match(a):
                    made += [("RENAMED_TO", t, bare(r[1]), None, None), ("RENAMED_FROM", bare(r[1]), t, None, None)]
                elif r := RENAME_COLUMN.match(a):
                    made.append(("RENAME", t, bare(r[1]), bare(r[2]), None))
                elif r := DROP_COLUMN.match(a):
                    made.append(("REMOVE", t, bare(r[1]), None, None))
                elif (r := ADD_COLUMN.match(a)) or (r := ALTER_COLUMN.match(a)):
                    if c := column(SET_TYPE.sub(r"\1 ", r[1]) if a[:5].lower() == "alter" else r[1]):
                        made.append(("ADD", t, *c, None))
        elif m := INDEX.match(s):
            made.append(("INDEX", bare(m[2]), bare(m[1]) if m[1] else None, None, None))
        elif m := DROP.match(s):
            made += [("DROP", bare(t), None, None, None) for t in items(m[1])]
        out += [(k, i, kind, table, name, value, first, last, line) for i, (kind, table, name, value, line) in enumerate(made)]
    if not parted:
        raise ValueError("no statements")
    return out


def migration_events(files: DataFrame) -> DataFrame:
    """project, version, path, status (SUCCESS, FAILED) and EVENT of migrations (project, path, text). A file that cannot be read whole has one row
    and no event; one without events of tables has one row too. Each file is read alone."""
    src = files.filter(is_migration(F.col("path"))).select("project", version_key(F.col("path")).alias("version"), "path", F.coalesce("text", F.lit("")).alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    schema = f"{kept}, status string, {EVENT}"
    arrow, nothing = to_arrow_schema(StructType.fromDDL(schema)), (None,) * len(EVENT.split(", "))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, made = [], []
            for k, text in enumerate(b.column(3).to_pylist()):
                try:
                    found = [("SUCCESS", *e) for e in events_of(text) or [nothing]]
                except ValueError:
                    found = [("FAILED", *nothing)]
                at += [k] * len(found)
                made += found
            if made:
                yield as_batch(arrow, [c.take(pa.array(at, pa.int64())) for c in b.columns[:3]], made)

    return src.mapInArrow(read, schema)


def as_batch(schema: pa.Schema, kept: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
    """A batch of columns as they are and, after them, rows."""
    return pa.RecordBatch.from_arrays([*kept, *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[len(kept) :])]], schema=schema)


def fold(events: Iterable[tuple], follow: bool) -> list[tuple]:
    """(table, kind, position, name, type, path, line_start, line_end) of the table that a history (path, kind, table, name, value, line_start, line_end, line) in order
    leaves; none after a drop."""
    now = source = None
    span, columns, indexes = (None, None), [], []
    for path, kind, table, name, value, line_start, line_end, line in events:
        if kind == "DROP":
            source, span, columns, indexes = None, (None, None), [], []
            continue
        if source is None:
            source = path
        now = table if kind != "RENAMED_TO" else name
        if kind == "CREATE":
            columns = []
            span = (line_start, line_end) if path == source else span
        elif kind == "ADD":
            low = name.lower()
            columns = [c for c in columns if c[0].lower() != low] + [(name, value, path if line is not None else None, line)]
        elif kind == "INDEX" and name is not None:
            indexes.append(name)
        elif kind == "REMOVE" and follow:
            low = name.lower()
            columns = [c for c in columns if c[0].lower() != low]
        elif kind == "RENAME" and follow:
            low = name.lower()
            columns = [(value, *c[1:]) if c[0].lower() == low else c for c in columns]
    if source is None:
        return []
    out = [(now, "TABLE", 0, now, None, source, span[0] or 1, span[1])]
    out += [(now, "COLUMN", i, c, t, p, n, n) for i, (c, t, p, n) in enumerate(columns, 1)]
    return out + [(now, "INDEX", i, x, None, None, None, None) for i, x in enumerate(indexes, 1)]


def replay_migrations(files: DataFrame, follow: bool = True) -> DataFrame:
    """project, table, kind (TABLE, COLUMN, INDEX), position, name, type, path, line_start, line_end of the tables that are left. `follow`: columns that
    are dropped or renamed and tables that are renamed; without it those statements change nothing.

    A table belongs to the file that names it first, its lines are those of its CREATE TABLE there. A column that is defined again goes to the end.
    It runs jobs while it is built (events and links are written)."""
    order = ["version", "path", "statement", "item"]
    e = migration_events(files).filter("kind is not null")
    e = e if follow else e.filter("kind not in ('RENAMED_TO', 'RENAMED_FROM')")
    # A life begins where a table comes in under a name, and after it has gone from it.
    own = W.partitionBy("table", "project").orderBy(*order)  # the name first: it tells more rows apart, so that sorting compares less
    begins = (F.col("kind") == "RENAMED_FROM") | (F.lag("kind").over(own) == "RENAMED_TO")
    e = e.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int")).withColumn("life", F.concat_ws("\u0001", "table", F.sum("begins").over(own.rowsBetween(W.unboundedPreceding, 0)).cast("string")))
    e = staged(e.drop("status", "begins"))
    out_ = e.filter("kind = 'RENAMED_TO'").select("project", "version", "path", "statement", (F.col("item") + 1).alias("item"), F.col("life").alias("root"))
    links = staged(e.filter("kind = 'RENAMED_FROM'").join(out_, ["project", *order]).select("project", "life", "root"))
    while links.head(1):  # by doubling: as many rounds as the logarithm of the longest chain of renames
        ahead = links.select("project", F.col("life").alias("root"), F.col("root").alias("next"))
        new = staged(links.join(ahead, ["project", "root"], "left").select("project", "life", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = new.select("project", "life", "root")
        if not new.filter("moved").head(1):
            break
    e = e.join(links, ["project", "life"], "left").withColumn("root", F.coalesce("root", "life")).filter("kind <> 'RENAMED_FROM'")
    kind = files.schema["project"].dataType.simpleString()
    schema = f"project {kind}, table string, kind string, position int, name string, type string, path string, line_start int, line_end int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = chain.from_iterable(zip(b.column(0).to_pylist(), *[c.to_pandas(integer_object_nulls=True).tolist() for c in b.columns[1:]]) for b in batches)
        made = []
        for (project, _), history in groupby(events, lambda x: x[:2]):
            made += [(project, *r) for r in fold((x[2:] for x in history), follow)]
            if len(made) >= 10_000:
                yield as_batch(arrow, [], made)
                made = []
        if made:
            yield as_batch(arrow, [], made)

    e = e.repartition("project", "root").sortWithinPartitions("root", "project", *order)
    return e.select("project", "root", "path", "kind", "table", "name", "value", "line_start", "line_end", "line").mapInArrow(tables, schema)


def migration_dependencies(files: DataFrame) -> DataFrame:
    """project, path, table: which migration works on which table (created, altered or indexed)."""
    return migration_events(files).filter("kind in ('CREATE', 'TOUCH', 'INDEX')").select("project", "path", "table").distinct()


def migration_outcomes(files: DataFrame) -> DataFrame:
    """project, path, status, reason of each migration."""
    each = migration_events(files).select("project", "path", "status").distinct()
    return each.withColumn("reason", F.when(F.col("status") == "SUCCESS", "SQL_PARSED").otherwise("SQL_PARSE_FAILED"))
