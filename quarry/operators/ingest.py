"""Which files of a source tree are taken in: binary test, ignore rules, scope, reasons, counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.privacy import contains_secret
from quarry.functions.text import count_lines, detect_language, extension
from quarry.operators.ordered import running_before

#: Extensions of binary files.
BINARY_EXTENSIONS = (
    "png jpg jpeg gif webp ico bmp pdf zip jar war ear class woff woff2 eot ttf otf mp3 mp4 webm mov avi wav ogg exe dll so dylib "
    "bin 7z tar gz bz2 rar xz sqlite db wasm pyc o a lib"
).split()
SNIFFED_BYTES = 8192
#: Files whose plain assigned values count as secrets.
CONFIG_FILE = r"\.(ya?ml|properties|ini|toml|txt|conf|config|env)$"
#: Folders of generated files; folders, names and extensions that hold secrets.
GENERATED = (".git", "node_modules", ".gradle", "build", "dist", "target", ".idea", ".vscode", "__pycache__", ".venv", "venv", "vendor", "generated")
SECRET_FOLDERS = (".ssh", ".aws", ".gnupg", ".config", ".azure", ".kube")
SECRET_FILES = "credentials credentials.json credentials.xml id_rsa id_dsa id_ecdsa id_ed25519 .netrc .npmrc .pypirc keychain keychain-db secrets.json secrets.yml secrets.yaml".split()
SECRET_EXTENSIONS = ("pem", "key", "p12", "pfx", "jks", "keystore", "keychain", "keychain-db")


def name_reason(name: Column, folder: bool) -> Column:
    """SECRET_PATH or GENERATED_DIRECTORY for the name of a folder or a file; null for others."""
    name = F.lower(name)
    ext = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))
    secret = name.isin(*SECRET_FOLDERS, *SECRET_FILES) | name.startswith(".env") | F.coalesce(ext.isin(*SECRET_EXTENSIONS), F.lit(False))
    return F.when(secret, "SECRET_PATH").when(name.isin(".git", ".ds_store", *(GENERATED if folder else ())), "GENERATED_DIRECTORY")


def is_binary(path: Column, content: Column) -> Column:
    """By its extension, else by a NUL byte among the first bytes."""
    name = F.replace(path, F.lit("\\"), F.lit("/"))
    by_name = F.coalesce(extension(name).isin(*BINARY_EXTENSIONS), F.lit(False))
    return by_name | F.coalesce(F.contains(F.substring(content.cast("binary"), 1, SNIFFED_BYTES), F.lit(b"\x00")), F.lit(False))


def inventory(files: DataFrame, max_size: int = 1 << 20, max_files: int = 50_000) -> DataFrame:
    """snapshot_id, path, size, language, line_count, content_hash, status of every file (snapshot_id, path, size, text, submodule), by the
    first that holds: EXCLUDED_SUBMODULE, EXCLUDED_COUNT once `max_files` earlier paths are accepted, EXCLUDED_SIZE, EXCLUDED_BINARY, else ACCEPTED.

    The measured columns are null for files that are not accepted."""
    fits = (F.col("size") <= max_size) & ~is_binary(F.col("path"), F.col("text")) & ~F.coalesce("submodule", F.lit(False))
    f = files.select("snapshot_id", "path", "size", F.coalesce("submodule", F.lit(False)).alias("submodule"), fits.alias("fits"), fits.cast("long").alias("one"), *[F.when(fits, c).alias(n) for c, n in ((detect_language(F.col("path")), "language"), (count_lines(F.col("text")), "line_count"), (F.sha2(F.col("text"), 256), "content_hash"))])
    f = running_before(f, ["snapshot_id"], ["path"], "one", "before")
    status = F.when(F.col("submodule"), "EXCLUDED_SUBMODULE").when(F.col("before") >= max_files, "EXCLUDED_COUNT").when(F.col("size") > max_size, "EXCLUDED_SIZE").when(~F.col("fits"), "EXCLUDED_BINARY").otherwise("ACCEPTED")
    taken = status == "ACCEPTED"
    return f.select("snapshot_id", "path", "size", *[F.when(taken, F.col(c)).alias(c) for c in ("language", "line_count", "content_hash")], status.alias("status"))


def skip_counts(inventoried: DataFrame) -> DataFrame:
    """snapshot_id, discovered_files and the number of files of each exclusion."""
    n = lambda s: F.count_if(F.col("status") == s)
    return inventoried.groupBy("snapshot_id").agg(F.count("*").alias("discovered_files"), *[n(f"EXCLUDED_{s.upper()}").alias(f"excluded_{s}") for s in ("count", "size", "binary", "submodule")])


def ignore_regex(line: str) -> tuple[str, bool, bool] | None:
    """(regular expression over a path, directory only, ignored) of one rule of an ignore file; null for blank lines and comments.

    `!` takes back, a slash inside or in front anchors at the root, a slash at the end means directories, `**` whole folders, `*` and `?`
    stay within a name. Character classes are refused, as are empty names."""
    if not line or line[0] == "#":
        return None
    ignored, line = line[0] != "!", line.removeprefix("!")
    while line.endswith(" ") and (len(line) - len(line[:-1].rstrip("\\")) - 1) % 2 == 0:
        line = line[:-1]
    only, body = line.endswith("/"), line.removesuffix("/")
    anchored, body = "/" in body, body.removeprefix("/")
    if not body:
        return None
    out = []
    parts = body.split("/")
    for i, part in enumerate(parts):
        if not part or re.search(r"(?<!\\)[\[\]]|(?<!\\)(?:\\\\)*\\$", part):
            raise ValueError("unsupported ignore rule")
        if part == "**":
            last = i == len(parts) - 1
            out.append((".+" if i else ".*") if last else "(?:[^/]+/)*")
            continue
        name = "".join({"*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t[-1])) for t in re.findall(r"\\.|.", part))
        out.append(name + ("/" if i < len(parts) - 1 else ""))
    return ("^" if anchored else "(?:^|/)") + "".join(out) + "$", only, ignored


def _verdict(rules: list[str], path: Column, directory: Column) -> Column:
    """Whether the last rule that matches a path hides it. The rules are few, so they are one expression."""
    out = F.lit(False)
    for form, only, hides in [r for line in rules if (r := ignore_regex(line))]:
        hit = path.rlike(form) & directory if only else path.rlike(form)
        out = F.when(hit, F.lit(hides)).otherwise(out)
    return out


def ignored(paths: DataFrame, rules: list[str]) -> DataFrame:
    """paths (path of a file) with `ignored`: a path is ignored if a folder above it or itself is, each by the last rule that matches it.

    An ignored folder hides all below it, whatever later rules say."""
    parts = F.split("path", "/")
    n = F.size(parts)
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("p"), (i < n).alias("d")))
    return paths.withColumn("ignored", F.exists(steps, lambda s: _verdict(rules, s["p"], s["d"])))


def in_scope(path: Column, directories: list[str], languages: list[str]) -> Column:
    """Whether the path's top directory (`.` for files at the root) and language (`other` where unknown) are asked for; no names mean all."""
    top = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(".")
    ok = top.isin(*directories) if directories else F.lit(True)
    return ok & (F.coalesce(detect_language(path), F.lit("other")).isin(*languages) if languages else F.lit(True))


def pruned_folders(files: DataFrame, rules: list[str], directories: list[str]) -> DataFrame:
    """root, folder, pruned, reason: of each folder that holds files and lies in or is a folder that is skipped whole, the topmost such folder and why.

    A folder is skipped by the first that holds: SECRET_PATH, GENERATED_DIRECTORY, SUBMODULE (a repository of its own lies in it), OUT_OF_SCOPE
    (at the top), IGNORED. The different folders are judged, not the files: each once, with its ancestors joined to it."""
    held = files.filter(F.contains("path", F.lit("/"))).select("root", F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = held.select("root", "folder", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    above = above.select("root", "folder", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("at"))
    each = above.select("root", "depth", "at").distinct()
    nested = files.select("root", F.regexp_extract("path", r"^(.+?)/\.git(?:/|$)", 1).alias("at")).filter("at <> ''").distinct().withColumn("nested", F.lit(True))
    name = F.substring_index("at", "/", -1)
    outside = (F.col("depth") == 1) & ~name.isin(*directories) if directories else F.lit(False)
    reason = F.coalesce(
        name_reason(name, True), F.when(F.col("nested"), "SUBMODULE"), F.when(outside, "OUT_OF_SCOPE"), F.when(_verdict(rules, F.col("at"), F.lit(True)), "IGNORED")
    )
    skipped = each.join(nested, ["root", "at"], "left").select("root", "at", reason.alias("reason")).filter("reason is not null")
    topmost = F.min(F.struct("depth", F.col("at").alias("pruned"), "reason")).alias("t")
    return above.join(skipped, ["root", "at"]).groupBy("root", "folder").agg(topmost).select("root", "folder", "t.pruned", "t.reason")


def admit(files: DataFrame, rules: list[str], directories: list[str], languages: list[str], max_size: int = 1 << 20, max_files: int = 50_000) -> DataFrame:
    """files (root, path, size, text, kind) with `reason`, the first that keeps the file out, null if it is taken in, and `pruned`, the folder that is
    skipped whole with it, if one is.

    First the folders, from the top: see pruned_folders. A file that they leave: SYMLINK, SECRET_PATH, GENERATED_DIRECTORY, HARD_LINK, IGNORED, OVERSIZED, BINARY,
    OUT_OF_SCOPE (at the root, or by its language), FILE_LIMIT, BINARY, SECRET_CONTENT. kind is `file`, `symlink` or `hard_link`."""
    path = F.col("path")
    folders = pruned_folders(files, rules, directories).withColumnRenamed("reason", "folder_reason")
    f = files.withColumn("folder", F.regexp_extract("path", "^(.*)/", 1)).join(folders, ["root", "folder"], "left")
    own = name_reason(F.substring_index("path", "/", -1), False)
    reason = (
        F.when(F.col("folder_reason").isNotNull(), F.col("folder_reason"))
        .when(F.col("kind") == "symlink", "SYMLINK")
        .when(own.isNotNull(), own)
        .when(F.col("kind") == "hard_link", "HARD_LINK")
        .when(_verdict(rules, path, F.lit(False)), "IGNORED")
        .when(F.col("size") > max_size, "OVERSIZED")
        .when(F.coalesce(extension(path).isin(*BINARY_EXTENSIONS), F.lit(False)), "BINARY")
        .when(~in_scope(path, directories, languages), "OUT_OF_SCOPE")
    )
    # Only accepted files count towards the limit.
    late = F.when(is_binary(path, F.col("text")), "BINARY").when(contains_secret(F.col("text"), path.rlike(CONFIG_FILE)), "SECRET_CONTENT")
    f = f.withColumn("reason", reason).withColumn("late", F.when(F.col("reason").isNull(), late))
    f = f.withColumn("one", (F.col("reason").isNull() & F.col("late").isNull()).cast("long"))
    f = running_before(f, ["root"], ["path"], "one", "before")
    limit = F.when(F.col("before") >= max_files, "FILE_LIMIT")
    return f.withColumn("reason", F.coalesce("reason", limit, "late")).drop("one", "before", "late", "folder", "folder_reason")


def exclusion_counts(admitted: DataFrame) -> DataFrame:
    """root, reason, n of what is kept out: files, and folders that are skipped whole, which count once."""
    out = admitted.filter("reason is not null")
    # A folder's files are put together before they are counted.
    folders = out.filter("pruned is not null").groupBy("root", "reason", "pruned").agg(F.lit(1).alias("one")).select("root", "reason", "one")
    return folders.unionByName(out.filter("pruned is null").select("root", "reason", F.lit(1).alias("one"))).groupBy("root", "reason").agg(F.count("*").alias("n"))


def preview_counts(files: DataFrame, depths: dict[str, str]) -> DataFrame:
    """kind, value, depth, n of accepted files: by language with the depth to which it is analysed, and by top directory."""
    depth = F.create_map(*[F.lit(x) for kv in depths.items() for x in kv])
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    lang = files.groupBy(F.coalesce(detect_language(F.col("path")), F.lit("other")).alias("value")).agg(F.count("*").alias("n"))
    lang = lang.select(F.lit("LANGUAGE").alias("kind"), "value", F.coalesce(F.try_element_at(depth, F.col("value")), F.lit("INVENTORY_ONLY")).alias("depth"), "n")
    folder = files.groupBy(top.alias("value")).agg(F.count("*").alias("n")).select(F.lit("DIRECTORY").alias("kind"), "value", F.lit(None).cast("string").alias("depth"), "n")
    return lang.unionByName(folder)
