"""Readers that turn files of other shapes into tables, and writers back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY_SCHEMA = (
    "id string, content string, memory_type string, importance double, confidence double, access_count int, content_hash string, tags array<string>, metadata string, "
    "namespace string, session_id string, repo string, git_ref string, expires_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, last_accessed_at timestamp_ntz"
)


def import_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Memories of JSON lines with the defaults of missing fields, and the lines that are none (no JSON, no content)."""
    raw = spark.read.schema(MEMORY_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("_bad", F.col("_corrupt").isNotNull() | F.col("content").isNull())
    good = raw.where(~F.col("_bad")).drop("_corrupt", "_bad")
    good = good.withColumn("memory_type", F.coalesce(F.lower("memory_type"), F.lit("context"))).withColumn("importance", F.coalesce("importance", F.lit(0.5))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).withColumn("access_count", F.coalesce("access_count", F.lit(0)))
    good = good.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("content_hash", F.sha2("content", 256)).withColumn("id", F.coalesce("id", F.left("content_hash", F.lit(32))))
    return good, raw.where("_bad").select(F.col("_corrupt").alias("line"))


def export(df: DataFrame, path: str, how: str = "jsonl") -> None:
    """Write memories as jsonl, csv (tags joined by ;) or markdown (a section each)."""
    if how == "jsonl":
        df.write.mode("overwrite").json(path)
    elif how == "csv":
        flat = df.withColumn("tags", F.array_join("tags", ";")) if "tags" in df.columns else df
        flat.select(*(c for c, t in flat.dtypes if not t.startswith(("array", "struct", "map")))).write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    elif how == "markdown":
        df.select(F.concat(F.lit("## "), "id", F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(how)


#: What `git log` must print for git_log: git log --name-only --pretty=format:COMMIT:%H|%P|%an|%aI|%s
GIT_FORMAT = "COMMIT:%H|%P|%an|%aI|%s"


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, parents, author, date, subject, files) of the text that git log prints in GIT_FORMAT."""
    rec = spark.read.option("lineSep", "COMMIT:").text(path).where(F.trim("value") != "")
    lines = F.split("value", "\n")
    head = F.split(lines[0], r"\|", 5)
    files = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), F.trim), lambda x: x != "")
    return rec.select(head[0].alias("hash"), F.filter(F.split(head[1], " "), lambda x: x != "").alias("parents"), head[2].alias("author"), F.to_timestamp_ntz(F.left(head[3], F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("date"), F.trim(head[4]).alias("subject"), files.alias("files"))


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def diff_lines(text: str) -> list[tuple[str, str, int]]:
    """(file, way, line) of a unified diff: added lines by their new number, removed ones by their old."""
    out: list[tuple[str, str, int]] = []
    file = old_file = None
    old = new = 0
    left_old = left_new = 0
    for line in text.splitlines():
        m = _HUNK.match(line)
        if m:
            old, new = int(m[1]), int(m[3])
            left_old, left_new = int(m[2] or 1), int(m[4] or 1)
        elif left_old <= 0 and left_new <= 0:
            if line.startswith("--- "):
                old_file = re.sub(r"^a/", "", line[4:].split("\t")[0])
            elif line.startswith("+++ "):
                name = re.sub(r"^b/", "", line[4:].split("\t")[0])
                file = old_file if name == "/dev/null" else name
        elif line.startswith("+"):
            out.append((file, "added", new))
            new, left_new = new + 1, left_new - 1
        elif line.startswith("-"):
            out.append((file, "removed", old))
            old, left_old = old + 1, left_old - 1
        elif not line.startswith("\\"):
            old, new, left_old, left_new = old + 1, new + 1, left_old - 1, left_new - 1
    return out


def _per_row(df: DataFrame, text: str, f, schema: str, *keep: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            rows = [(*kept, *row) for *kept, t in b[[*keep, text]].itertuples(index=False) if t is not None for row in f(t)]
            yield pd.DataFrame(rows, columns=[*keep, *names])

    types = dict(df.dtypes)
    return df.select(*keep, text).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keep), schema]))


def unified_diffs(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., file_path, way, line) of the diffs in a column."""
    return _per_row(df, text, diff_lines, "file_path string, way string, line int", *keep)


LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "go": "go", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "md": "markdown", "yaml": "yaml", "yml": "yaml"}


def source_tree(spark: SparkSession, path: str, extensions: tuple[str, ...] = tuple(LANGUAGES), ignore: str = r"(^|/)(\.git|target|node_modules|dist|build|\.venv)/") -> DataFrame:
    """(file_path, lang, text, content_hash) of the files of a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(path.rstrip("/")) + "/", "")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    lang = F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), ext)
    return raw.select(rel.alias("file_path"), lang.alias("lang"), F.decode("content", "utf-8").alias("text"), F.sha2("content", 256).alias("content_hash")).where(~F.col("file_path").rlike(ignore))


def _toml_rows(text: str, package: str, tables: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    import tomllib

    try:
        t = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    own = t.get(package) or {}
    if own.get("name"):
        yield "package", own["name"], str(own.get("version", ""))
    for table in tables:
        deps = t
        for part in table.split("."):
            deps = deps.get(part, {}) if isinstance(deps, dict) else {}
        if isinstance(deps, list):
            for d in deps:
                m = re.match(r"\s*([A-Za-z0-9._-]+)\s*(.*)", str(d))
                if m:
                    yield "dependency", m[1], m[2].strip()
        elif isinstance(deps, dict):
            for k, v in deps.items():
                yield "dependency", k, v if isinstance(v, str) else str((v or {}).get("version", "")) if isinstance(v, dict) else ""


def manifest_rows(name: str, text: str) -> list[tuple[str, str, str]]:
    """(role, package, version) of one of eight kinds of manifest, by its file name; nothing for others or malformed ones."""
    out: list[tuple[str, str, str]] = []
    if name == "Cargo.toml":
        out = list(_toml_rows(text, "package", ("dependencies", "dev-dependencies", "build-dependencies")))
    elif name == "pyproject.toml":
        out = list(_toml_rows(text, "project", ("project.dependencies",)))
    elif name in ("package.json", "composer.json"):
        try:
            j = json.loads(text)
        except ValueError:
            return []
        if j.get("name"):
            out.append(("package", j["name"], j.get("version", "")))
        for table in ("dependencies", "devDependencies", "peerDependencies") if name == "package.json" else ("require", "require-dev"):
            out += [("dependency", k, v) for k, v in (j.get(table) or {}).items()]
    elif name == "go.mod":
        if m := re.search(r"^module\s+(\S+)", text, re.M):
            out.append(("package", m[1], ""))
        block = "\n".join(re.findall(r"require\s*\(([^)]*)\)", text)) + "\n" + "\n".join(re.findall(r"^require\s+(\S+\s+\S+)", text, re.M))
        out += [("dependency", a, b) for a, b in re.findall(r"^\s*(\S+\.\S+)\s+(v\S+)", block, re.M)]
    elif name == "pom.xml":
        import xml.etree.ElementTree as E

        try:
            root = E.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text))
        except E.ParseError:
            return []
        get = lambda e, k: (e.findtext(k) or "").strip()
        out.append(("package", f"{get(root, 'groupId')}:{get(root, 'artifactId')}", get(root, "version")))
        out += [("dependency", f"{get(d, 'groupId')}:{get(d, 'artifactId')}", get(d, "version")) for d in root.findall("./dependencies/dependency")]
    elif name.endswith(".csproj"):
        out.append(("package", name[:-7], ""))
        out += [("dependency", a, b) for a, b in re.findall(r'<PackageReference\s+Include="([^"]+)"(?:\s+Version="([^"]*)")?', text)]
    elif name == "Gemfile":
        out += [("dependency", a, b) for a, b in re.findall(r"""^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?""", text, re.M)]
    return out


def manifests(files: DataFrame) -> DataFrame:
    """(file_path, role, package, version) of (file_path, text)."""
    both = files.select("file_path", F.to_json(F.struct(F.element_at(F.split("file_path", "/"), -1).alias("n"), "text")).alias("_j"))
    return _per_row(both, "_j", lambda j: (lambda x: manifest_rows(x["n"], x.get("text") or ""))(json.loads(j)), "role string, package string, version string", "file_path")


METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def spec_rows(text: str) -> list[tuple[str, str, str, str, str]]:
    """(kind, method, path, operation, summary) of an OpenAPI / Swagger or AsyncAPI (2 and 3) document in JSON."""
    try:
        d = json.loads(text)
    except ValueError:
        return []
    if not isinstance(d, dict):
        return []
    out = []
    if "openapi" in d or "swagger" in d:
        for path, ops in (d.get("paths") or {}).items():
            for m, op in (ops or {}).items():
                if m.lower() in METHODS and isinstance(op, dict):
                    out.append(("endpoint", m.upper(), path, op.get("operationId") or "", op.get("summary") or op.get("description") or ""))
    elif str(d.get("asyncapi", "")).startswith("3"):
        for name, op in (d.get("operations") or {}).items():
            channel = str((op.get("channel") or {}).get("$ref", "")).rsplit("/", 1)[-1]
            address = ((d.get("channels") or {}).get(channel) or {}).get("address") or channel
            way = {"send": "publish", "receive": "subscribe"}.get(op.get("action"), "")
            out.append(("channel", way, address, name, op.get("summary") or ""))
    elif "asyncapi" in d:
        for path, ch in (d.get("channels") or {}).items():
            for way in ("publish", "subscribe"):
                if isinstance((ch or {}).get(way), dict):
                    out.append(("channel", way, path, ch[way].get("operationId") or "", ch[way].get("summary") or ch[way].get("description") or ""))
    return out


def api_specs(files: DataFrame) -> DataFrame:
    """(file_path, kind, method, path, operation, summary) of (file_path, text)."""
    return _per_row(files, "text", spec_rows, "kind string, method string, path string, operation string, summary string", "file_path")


def sections(text: str) -> list[tuple[int, str, str]]:
    """(number, heading, text): Markdown cut at ## and ### (up to three blanks in front, not in code fences), YAML at ---."""
    out: list[tuple[int, str, list[str]]] = [(0, "", [])]
    fence = False
    yaml = not re.search(r"^ {0,3}#{2,3} ", text, re.M) and re.search(r"^---\s*$", text, re.M)
    for line in text.splitlines():
        if line.lstrip().startswith("```"):
            fence = not fence
        m = None if fence or yaml else re.match(r"^ {0,3}(#{2,3}) +(.*?)\s*#*$", line)
        if m or (yaml and re.match(r"^---\s*$", line)):
            out.append((len(out), m[2] if m else "", [line] if m else []))
        else:
            out[-1][2].append(line)
    kept = [(h, "\n".join(x)) for _, h, x in out if "".join(x).strip()]
    return [(i, h, t) for i, (h, t) in enumerate(kept)]


def document_sections(files: DataFrame) -> DataFrame:
    """(file_path, section, heading, text)."""
    both = files.select("file_path", F.col("text").alias("_text"))
    return _per_row(both, "_text", sections, "section int, heading string, text string", "file_path")


HOOK_SCHEMA = "tool_name string, tool_input string, tool_response string, session_id string, cwd string, ts timestamp_ntz"


def hook_events(df: DataFrame, column: str = "value", most_bytes: int = 100_000) -> DataFrame:
    """Typed hook payloads out of JSON texts: session_id, tool_name, file_path, directory, pattern, response, cwd, created_at, hash. Payloads above ``most_bytes`` are refused by the interface and come out without response."""
    j = F.from_json(column, HOOK_SCHEMA)
    own = df.select(j.alias("j"), F.sha2(column, 256).alias("hash"), F.octet_length(column).alias("n")).where("j.tool_name IS NOT NULL")
    path = F.coalesce(F.get_json_object("j.tool_input", "$.file_path"), F.get_json_object("j.tool_input", "$.path"))
    from ..functions import scalars as S

    rel = S.relative_path(path, F.coalesce("j.cwd", F.lit("")))
    return own.select("j.session_id", "j.tool_name", rel.alias("file_path"), S.directory_of(rel).alias("directory"), F.get_json_object("j.tool_input", "$.pattern").alias("pattern"), F.when(F.col("n") <= most_bytes, response_text(F.col("j.tool_response"))).alias("response"), "j.cwd", F.col("j.ts").alias("created_at"), "hash")


def response_text(c: Column) -> Column:
    """The text of a tool's response: a string, file.content, text, stdout, or the JSON itself."""
    return F.coalesce(F.get_json_object(c, "$.file.content"), F.get_json_object(c, "$.text"), F.get_json_object(c, "$.stdout"), c)
