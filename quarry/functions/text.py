"""Scalar column functions over paths, names, URLs and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension.
LANGUAGES = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "sql": "sql", "yml": "yaml", "yaml": "yaml", "tf": "hcl", "md": "markdown", "xml": "xml", "gradle": "gradle",
    "sh": "shell", "bash": "shell", "json": "json", "html": "html", "htm": "html", "css": "css", "scss": "scss", "properties": "properties", "toml": "toml", "swift": "swift",
    "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    name = base_name(path)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))


def _slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def detect_language(path: Column) -> Column:
    """Language of a path by its file name; null where unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    name = base_name(_slashes(path))
    by_extension = F.try_element_at(table, F.coalesce(extension(_slashes(path)), F.lit("")))
    return F.when(name.isin("Dockerfile", "dockerfile"), "dockerfile").when(name.endswith(".gradle.kts"), "gradle").otherwise(by_extension)


#: What makes a path one of an area, in the order in which the areas are tried: endings and parts of the path in lower case,
#: and parts and beginnings of the path as it is.
AREAS = {
    "BACKEND": {"ends": (".java",), "holds": ("src/main/java",)},
    "FRONTEND": {"ends": (".tsx", ".jsx"), "holds_lower": ("/frontend/", "src/pages/", "src/components/")},
    "DATABASE": {"ends": (".sql",), "holds": ("db/migration",)},
    "DEVOPS": {"holds": (".github/workflows",)},
    "INFRASTRUCTURE": {"ends": (".tf",), "holds_lower": ("dockerfile", "docker-compose")},
    "DOCUMENTATION": {"ends": (".md",), "holds": ("/docs/",), "begins": ("docs/",)},
    "BUILD_TOOLING": {"ends": (".gradle", ".gradle.kts", "pom.xml", "package.json")},
}
TEST_PATH = r"(^|/)(test|tests|__tests__)/|\.(test|spec)\.[cm]?[jt]sx?$"


def tag_area(path: Column) -> Column:
    """Area of a path: the first rule that holds; null without one."""
    p = _slashes(path)
    low = F.lower(p)
    out = F.when(low.rlike(TEST_PATH), "TESTING")
    for area, rule in AREAS.items():
        tests = [low.endswith(x) for x in rule.get("ends", ())] + [F.contains(low, F.lit(x)) for x in rule.get("holds_lower", ())]
        tests += [F.contains(p, F.lit(x)) for x in rule.get("holds", ())] + [F.startswith(p, F.lit(x)) for x in rule.get("begins", ())]
        if area == "FRONTEND":  # scripts are the front end's unless they lie in the back end
            tests.append(low.rlike(r"\.(ts|js|mjs)$") & ~F.contains(low, F.lit("/backend/")))
        out = out.when(reduce(lambda a, b: a | b, tests), area)
    return F.when(F.trim(path) != "", out)


def count_config_lines(text: Column) -> Column:
    """Lines of a configuration file for spans: LF, CRLF and CR end a line; at least one."""
    return F.greatest(F.size(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")), F.lit(1))


def line_of(text: Column, token: str) -> Column:
    """Number of the first line that holds the token; null where none does."""
    at = F.instr(text, token)
    return F.when(at > 0, at - F.length(F.replace(F.substring(text, F.lit(1), at - 1), F.lit("\n"), F.lit(""))))


def excerpt(text: Column, most: int = 80) -> Column:
    """The first line, cut."""
    return F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, most)


def abbrev_sha(sha: Column, n: int = 10) -> Column:
    return F.substring(sha, 1, n)


def format_author(name: Column, email: Column) -> Column:
    """`name <email>`, or the one that is known; null without either."""
    n, e = F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(email), F.lit(""))
    return F.when(n.isNotNull() & e.isNotNull(), F.concat(n, F.lit(" <"), e, F.lit(">"))).otherwise(F.coalesce(n, e))


def count_lines(text: Column) -> Column:
    """Line feeds, and one more if the last line has none."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(n + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def url_path(url: Column) -> Column:
    """The path of a URL: no scheme, host, query or one trailing slash, with a leading slash."""
    p = F.regexp_replace(F.trim(url), r"^[^\n]*?://[^/]*", "")
    p = F.regexp_replace(p, r"\?[\s\S]*$", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)


def normalize_template(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\$?\{[^}/]+\}|:[A-Za-z_][A-Za-z0-9_]*", "{}"))


def join_route(prefix: Column, path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), path), "/+", "/"), "(.)/$", "$1")


def to_snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def path_prefix(path: Column) -> Column:
    """First segment of a path in lower case; null where it is blank or a template."""
    s = F.substring_index(F.regexp_replace(path, "^/", ""), "/", 1)
    return F.when((F.trim(s) != "") & ~s.startswith("{"), F.lower(s))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, two blanks before and one after each."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def text_match(text: Column, query: str) -> Column:
    """Whether all word tokens of the query are tokens of the text."""
    import re

    tokens = [F.lit(t) for t in dict.fromkeys(re.findall(r"[a-z0-9_]+", query.lower()))]
    return F.size(F.array_except(F.array(*tokens), F.split(F.lower(text), "[^a-z0-9_]+"))) == 0


def contains_ci(text: Column, query: str) -> Column:
    return F.contains(F.lower(text), F.lit(query.lower()))


def glob_regex(pattern: str) -> str:
    """`**/` any folders, `**` anything, `*` within a folder; `?` makes the character before it optional."""
    out, i = "^", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + (pattern[i] if pattern[i] == "?" else f"\\{pattern[i]}" if pattern[i] in r".+()[]{}^$|\\" else pattern[i]), i + 1
    return out + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def migration_sort_key(path: Column) -> Column:
    """Versioned files in version order, others after them."""
    v = F.regexp_extract(base_name(path), r"^V([0-9]+(?:[_.][0-9]+)*)__", 1)
    return F.when(v != "", F.array_join(F.transform(F.split(v, "[_.]"), lambda x: F.lpad(x, 12, "0")), ".")).otherwise(F.concat(F.lit("~"), path))


def wilson_lower(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Lower bound of a share at 95 %; null for no trials."""
    n, z2 = F.nullif(n, F.lit(0)), z * z
    p = hits / n
    return (p + F.lit(z2) / (n * 2) - F.lit(z) * F.sqrt(p * (F.lit(1) - p) / n + F.lit(z2) / (n * n * 4))) / (F.lit(1) + F.lit(z2) / n)


#: First parts of packages that name a vendor.
VENDORS = ("com", "org", "net", "io")


def package_cluster(key: Column) -> Column:
    """Of a Java type's key, the part of its package that says what it is for: the third after a vendor's prefix, else the first; the last
    where there are fewer. Null for other keys and types without a package."""
    name = F.regexp_extract(key, r"^java:(.+)\.[^.]*$", 1)
    parts = F.split(name, r"\.")
    at = F.when((F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin(*VENDORS), 2).otherwise(0)
    return F.when(name != "", F.lower(F.coalesce(F.get(parts, at), F.element_at(parts, -1))))


def parse_skip_count(text: Column, most: int = 2_147_483_647) -> Column:
    """A recorded count: digits only, within bounds; null otherwise."""
    n = F.when(text.rlike(r"^[0-9]{1,18}$"), text.try_cast("long"))
    return F.when(n <= most, n)


def meta_get(metadata: Column, key: str) -> Column:
    return F.get_json_object(metadata, f"$.{key}")


def meta_merge(old: Column, new: Column) -> Column:
    """Two JSON objects merged at their first level, the new one's keys winning; keys in order. Values stay as text."""
    both = F.map_zip_with(*[F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (old, new)], lambda k, a, b: F.coalesce(b, a))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both))))
