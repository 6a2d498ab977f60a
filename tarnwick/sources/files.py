"""File sources: text, folders, mail folders, office documents. All read through Spark, so any Hadoop path works."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CHARS = 2_000_000
MAX_BYTES = 5 * 1024 * 1024
SUFFIXES = (".txt", ".md", ".pdf", ".docx", ".xlsx", ".pptx", ".csv")
#: Encodings tried in turn; the last reads any bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "cp1252", "latin-1")


def text_files(spark: SparkSession, path: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """(path, content, size): one row per file, cut to max_chars."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return whole.select("path", F.substring("value", 1, max_chars).alias("content"), F.octet_length("value").cast("long").alias("size"))


def folder(spark: SparkSession, path: str, suffix: str | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's files of the allowed kinds, or of one kind."""
    allowed = [suffix] if suffix else list(suffixes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*allowed))


def scan(spark: SparkSession, path: str, state: DataFrame, suffixes: tuple[str, ...] = (".md", ".txt"), skip: tuple[str, ...] = (), max_bytes: int = MAX_BYTES, pruned: tuple[str, ...] = (), rules: dict[str, list[str]] | None = None) -> DataFrame:
    """(path, change, mtime): incremental scan against state (path, mtime); only metadata are read. Folders named in pruned are left out, and what the ignore rules of any folder around a file ignore."""
    from tarnwick.operators.catalog import state_diff

    root = path.rstrip("/") + "/"
    found = folder(spark, path, suffixes=suffixes).where(F.col("length") <= max_bytes).select(F.expr(f"substring(path, instr(path, '{root}') + {len(root)})").alias("path"), F.col("modificationTime").cast("double").alias("mtime"))
    if skip:
        found = found.where(~F.element_at(F.split("path", "/"), -1).isin(*skip))
    if pruned:
        found = found.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(p) for p in pruned])) | ~F.contains("path", F.lit("/")))
    if rules:
        found = found.where(~ignored_nested(F.col("path"), rules))
    return state_diff(found, state)


def ignore_pattern(rule: str) -> tuple[str, bool]:
    """(regular expression over relative paths, whether the rule un-ignores) of one line of an ignore file."""
    rule, back = rule.rstrip("\n").rstrip(), False
    if rule.startswith("!"):
        rule, back = rule[1:], True
    folder_only, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
    rule = rule.strip("/")
    out, i = "", 0
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder_only else "(?:/.*)?$"), back


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last matching rule ignores a relative path."""
    out = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.lstrip().startswith("#"):
            pattern, back = ignore_pattern(rule)
            out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def ignored_nested(path: Column, rules: dict[str, list[str]]) -> Column:
    """`ignored` by rules of several folders ("" is the root): each folder's rules see paths below it, and those of deeper folders win."""
    out = F.lit(None).cast("boolean")
    for at in sorted(rules, key=lambda d: d.count("/") + bool(d)):
        prefix = at.rstrip("/") + "/" if at else ""
        below = F.substring(path, len(prefix) + 1, 1 << 20)
        for rule in rules[at]:
            if rule.strip() and not rule.lstrip().startswith("#"):
                pattern, back = ignore_pattern(rule)
                out = F.when(path.startswith(prefix) & below.rlike(pattern), F.lit(not back)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def mail_folder(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Converted mail: one folder each with meta.json and body.md; only: the folders' names, else all."""
    if only is not None:
        all_ = mail_folder(spark, path)
        return all_.where(F.col("mail_id").isin(*only)) if only else all_.limit(0)
    key = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    read = lambda name: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    meta = read("meta.json").schema("mail_id string, subject string, sender string, recipients string, received string, folder_path string").option("multiLine", "true").json(path).withColumn("dir", key)
    body = read("body.md").text(path, wholetext=True).select(key.alias("dir"), F.col("value").alias("body"))
    return meta.join(body, "dir", "left").drop("dir")


def decode(raw: bytes | None) -> str:
    """Text of bytes: by their byte order mark, else as UTF-16 where every other byte is zero, else by the first encoding that reads them."""
    raw = raw or b""
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        return raw.decode("utf-16", "replace")
    if len(raw) >= 8 and len(raw) % 2 == 0:
        for zeros, name in ((raw[1::2], "utf-16-le"), (raw[::2], "utf-16-be")):
            if zeros.count(0) > 0.9 * len(zeros):
                return raw.decode(name, "replace")
    for e in ENCODINGS:
        try:
            return (raw or b"").decode(e)
        except UnicodeDecodeError:
            continue
    return ""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == name)


def pipe_table(rows: list[list[str]], header: bool = True) -> str:
    """Rows as a pipe table; | is escaped, line feeds become spaces."""
    if not rows:
        return "(empty sheet)"
    width = max(map(len, rows))
    cells = [[c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    head, rest = (cells[0], cells[1:]) if header else ([f"Column {i + 1}" for i in range(width)], cells)
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * width, *rest])


def docx_markdown(raw: bytes) -> str:
    """Headings by style, paragraphs and tables in document order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body")
    out = []
    for x in body:
        if _local(x.tag) == "p":
            style = next((v for s in x.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            level = re.fullmatch(r"[Hh]eading ?([1-6])", style)
            if text := _texts(x).strip():
                out.append("#" * int(level[1]) + " " + text if level else text)
        elif _local(x.tag) == "tbl":
            out.append(pipe_table([[_texts(c).strip() for c in r if _local(c.tag) == "tc"] for r in x if _local(r.tag) == "tr"]))
    return "\n\n".join(out)


def xlsx_rows(raw: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows) with blank rows left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [_texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = [{(("r:" if "relationships" in k else "") + _local(k)): v for k, v in s.attrib.items()} for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        rels = "xl/_rels/workbook.xml.rels"
        targets = {r.attrib["Id"]: r.attrib["Target"] for r in ElementTree.fromstring(z.read(rels))} if rels in names else {}
        out = []
        for i, s in enumerate(sheets, 1):
            target = targets.get(s.get("r:id", ""), f"worksheets/sheet{i}.xml")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            rows = []
            for r in ElementTree.fromstring(z.read(part)).iter() if part in names else ():
                if _local(r.tag) != "row":
                    continue
                cells: list[str] = []
                for c in r:
                    at = 0
                    for ch in re.sub(r"[^A-Z]", "", c.attrib.get("r", "")):
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (max(at - 1, len(cells)) - len(cells))
                    v = _texts(c, "v")
                    cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else _texts(c) if c.attrib.get("t") == "inlineStr" else v)
                if any(x.strip() for x in cells):
                    rows.append(cells)
            out.append((s.get("name", f"Sheet{i}"), rows))
    return out


def xlsx_text(raw: bytes) -> str:
    return "\n".join(line for name, rows in xlsx_rows(raw) for line in [f"# Sheet: {name}", *("\t".join(r) for r in rows)])


def xlsx_markdown(raw: bytes) -> str:
    return "\n\n".join(f"## {name}\n\n{pipe_table(rows)}" for name, rows in xlsx_rows(raw))


def pptx_markdown(raw: bytes) -> str:
    """Slides in order: title, texts, tables, notes."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for i, n in enumerate(names, 1):
            title, lines = "", []
            for x in ElementTree.fromstring(z.read(n)).iter():
                if _local(x.tag) == "sp":
                    kind = next((p.attrib.get("type", "") for p in x.iter() if _local(p.tag) == "ph"), "")
                    texts = [t for p in x.iter() if _local(p.tag) == "p" and (t := _texts(p).strip())]
                    if kind in ("title", "ctrTitle") and texts and not title:
                        title = " ".join(texts)
                    else:
                        lines += texts
                elif _local(x.tag) == "tbl":
                    lines.append(pipe_table([[_texts(c).strip() for c in r if _local(c.tag) == "tc"] for r in x if _local(r.tag) == "tr"]))
            rels = n.replace("slides/", "slides/_rels/") + ".rels"
            notes = [r.attrib["Target"] for r in ElementTree.fromstring(z.read(rels)) if r.attrib.get("Type", "").endswith("/notesSlide")] if rels in z.namelist() else []
            for note in notes:
                said = [t for x in ElementTree.fromstring(z.read("ppt/" + note.removeprefix("../"))).iter() if _local(x.tag) == "sp" and any(p.attrib.get("type") == "body" for p in x.iter() if _local(p.tag) == "ph") for p in x.iter() if _local(p.tag) == "p" and (t := _texts(p).strip())]
                lines += ["Notes: " + " ".join(said)] if said else []
            out.append("\n\n".join([f"## Slide {i}" + (f": {title}" if title else ""), *lines]))
    return "\n\n".join(out)


def pdf_text(raw: bytes) -> str:
    """Text of a PDF's pages, in the order of their objects, a blank line between; text shown by plain strings in the usual one-byte encodings. Fonts with encodings of their own need an outside reader."""
    import zlib

    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw, re.S)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]

    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def literal(s: bytes) -> str:
        s = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else escapes.get(m[1], m[1]), s, flags=re.S)
        return s[2:].decode("utf-16-be", "replace") if s.startswith(b"\xfe\xff") else s.decode("cp1252", "replace")

    pages = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        content = b"\n".join(stream(objects.get(int(r), b"")) for r in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])) if refs else b""
        lines = [""]
        for m in re.finditer(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|\bT[dDm*]|[\"'](?=\s)|-?\d+(?:\.\d+)?(?=\s*[(<\]])", content, re.S):
            t = m[0]
            if t[:1] == b"(":
                lines[-1] += literal(t[1:-1])
            elif t[:1] == b"<":
                lines[-1] += literal(bytes.fromhex(re.sub(rb"\s", b"", t[1:-1]).decode().ljust(2, "0")[: len(t) // 2 * 2]))
            elif t[:1].isdigit() or t[:1] == b"-":
                if float(t) < -180 and lines[-1][-1:].strip():
                    lines[-1] += " "
            elif lines[-1]:
                lines.append("")
        pages.append("\n".join(x.strip() for x in lines if x.strip()))
    return "\n\n".join(p for p in pages if p)


def rtf_text(raw: bytes) -> str:
    """Text of an RTF file: paragraphs, tabs, escaped and Unicode characters; tables of fonts, colours and styles, pictures and starred groups have none."""
    text, out, stack, hidden, skip = raw.decode("latin-1"), [], [], False, 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", text):
        word, number, code, mark, brace, plain = m.groups()
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif mark == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            hidden = True
        elif hidden:
            continue
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "u":
            out.append(chr(int(number) & 0xFFFF))
            skip = 1
        elif code:
            out.append("" if skip else bytes([int(code, 16)]).decode("cp1252", "replace"))
            skip = 0
        elif mark and mark in "\\{}":
            out.append(mark)
        elif mark == "~":
            out.append(" ")
        elif plain:
            out.append(plain[skip:])
            skip = 0
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


# Names of streams, in UTF-16, that tell what an OLE file is.
OLE_STREAMS = (("WordDocument", ".doc"), ("Workbook", ".xls"), ("Book", ".xls"), ("PowerPoint Document", ".ppt"), ("__properties_version1.0", ".msg"))


def sniff(raw: bytes | None) -> str:
    """Suffix by magic bytes; zip and OLE files by what they hold."""
    raw = raw or b""
    if raw.startswith(b"\xd0\xcf\x11\xe0"):
        return next((k for name, k in OLE_STREAMS if name.encode("utf-16-le") in raw), ".ole")
    for magic, kind in ((b"%PDF", ".pdf"), (b"\x89PNG", ".png"), (b"\xff\xd8\xff", ".jpg"), (b"GIF8", ".gif"), (b"{\\rtf", ".rtf"), (b"\xd0\xcf\x11\xe0", ".ole"), (b"BM", ".bmp")):
        if raw.startswith(magic):
            return kind
    if raw.startswith(b"PK\x03\x04"):
        try:
            names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
        except zipfile.BadZipFile:
            return ".zip"
        return next((k for p, k in (("word/", ".docx"), ("xl/", ".xlsx"), ("ppt/", ".pptx")) if any(n.startswith(p) for n in names)), ".zip")
    return ".html" if raw[:200].lstrip().lower().startswith((b"<!doctype html", b"<html")) else ""


#: Suffix -> bytes to text. Register others, such as a PDF reader, here.
READERS: dict[str, Callable[[bytes], str]] = {".pdf": pdf_text, ".rtf": rtf_text, **dict.fromkeys((".png", ".jpg", ".gif", ".bmp"), lambda b: f"[image, {len(b)} bytes]"), ".docx": docx_markdown, ".xlsx": xlsx_text, ".pptx": pptx_markdown, ".txt": decode, ".md": decode, ".csv": lambda b: "```csv\n" + decode(b) + "\n```", ".html": decode}


def parsed(files: DataFrame) -> DataFrame:
    """(path, content, error) of binary files by suffix, sniffed where there is none; an unreadable file has an error instead of stopping the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                m = re.search(r"\.[^./]+$", p)
                kind = m[0].lower() if m else sniff(raw)
                try:
                    texts.append(READERS[kind](raw)[:MAX_CHARS])
                    errors.append(None)
                except Exception as e:  # one bad file is a row, not a failed job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content string, error string")


def html_markdown(html: str | None) -> str:
    """Headings, links, lists, emphasis and paragraphs as markdown."""
    from html.parser import HTMLParser

    out: list[str] = []
    hrefs: list[str] = []

    class Reader(HTMLParser):
        skip = 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "head"):
                self.skip += 1
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag in ("p", "div", "ul", "ol", "table", "tr", "blockquote"):
                out.append("\n\n" if tag != "tr" else "\n")
            elif tag == "li":
                out.append("\n* ")
            elif tag == "br":
                out.append("\n")
            elif tag in ("b", "strong", "i", "em"):
                out.append("**" if tag in ("b", "strong") else "*")
            elif tag == "a":
                hrefs.append(dict(attrs).get("href") or "")
                out.append("[")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "head"):
                self.skip = max(0, self.skip - 1)
            elif tag in ("b", "strong", "i", "em"):
                out.append("**" if tag in ("b", "strong") else "*")
            elif tag == "a" and hrefs:
                out.append(f"]({hrefs.pop()})")

        def handle_data(self, data):
            if not self.skip:
                out.append(re.sub(r"\s+", " ", data))

    Reader(convert_charrefs=True).feed(html or "")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n|\n[ \t]+(?=\S)", "\n", "".join(out))).strip()


def substitute(value, env: dict[str, str]):
    """${NAME} in a nested configuration; a whole-string value becomes a bool, int or float where it reads as one."""
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value
    if not (m := re.fullmatch(r"\$\{(\w+)\}", value)):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), value)
    text = env.get(m[1], "")
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def mail_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Mail that an outside worker wrote as JSON lines, and its lines that can't be read, with their errors."""
    schema = "mail_id string, subject string, sender string, recipients string, received string, folder_path string, body string, error string, _corrupt string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = F.col("error").isNull() & F.col("_corrupt").isNull() & F.col("subject").isNotNull()
    key = F.substring(F.sha1(F.concat_ws("|", "folder_path", "subject", "received", "sender")), 1, 20)
    return rows.where(good).withColumn("mail_id", F.coalesce("mail_id", key)).drop("error", "_corrupt"), rows.where(~good).select(F.coalesce("error", "_corrupt", F.lit("no subject")).alias("error"))


def mail_archives(archives: DataFrame, factory: Callable[[], Callable[[bytes], Iterator[dict]]]) -> DataFrame:
    """(path, folder_path, subject, sender, recipients, received, body) of mail archives (path, content) by a reader the caller brings, one a task. Items with byte strings are decoded, items that aren't mail are left out."""
    fields = ("folder_path", "subject", "sender", "recipients", "received", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = factory()
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [[decode(v) if isinstance(v, bytes) else None if v is None else str(v) for v in (item.get(f) for f in fields)] for item in read(raw) if isinstance(item, dict) and item.get("subject") is not None]
                for at in range(0, len(rows), 500):
                    part = rows[at : at + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), *(pa.array(c, pa.string()) for c in zip(*part, strict=True))], names=["path", *fields])

    return archives.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{f} string" for f in fields))


def ir_corpus(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, judgements) of a folder with corpus.jsonl, queries.jsonl and qrels/<split>.tsv; a document's content is its title, a blank line, its text."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl")
    asked = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl")
    judged = spark.read.option("sep", "\t").option("header", "true").schema("query_id string, doc_id string, grade int").csv(f"{path}/qrels/{split}.tsv")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return docs.select(F.col("_id").alias("document_id"), F.concat(blank("title"), F.lit("\n\n"), blank("text")).alias("content")), asked.select(F.col("_id").alias("query_id"), "text").join(judged.select("query_id").distinct(), "query_id", "left_semi"), judged


def flatten_answer(answers: DataFrame, col: str = "body", most: int = 50) -> DataFrame:
    """(content, score, source) of a retrieval service's JSON answers, whatever object or list they lie in; most is kept within 1 and 50."""
    import json

    most = min(50, max(1, int(most)))

    def walk(x):
        if isinstance(x, list):
            for y in x:
                yield from walk(y)
        elif isinstance(x, dict):
            if isinstance(x.get("content"), str):
                yield x["content"], x.get("score", x.get("similarity")), str(x.get("document_name", x.get("source", "")))
            else:
                for y in x.values():
                    yield from walk(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for t in b.column(0).to_pylist() for r in list(walk(json.loads(t or "null")))[:most]]
            c, s, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array([None if v is None else float(v) for v in s], pa.float64()), pa.array(n, pa.string())], names=["content", "score", "source"])

    return answers.select(col).mapInArrow(run, "content string, score double, source string")


def finalize_state(state: DataFrame, changes: DataFrame, profiles: DataFrame) -> DataFrame:
    """The scan's next state: without removed files, with the profiles (path, …) of new and changed ones in place of the old."""
    touched = changes.select("path").distinct()
    fresh = profiles.join(changes.where("change <> 'removed'").select("path", "mtime"), "path")
    return state.join(touched, "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def scan_status(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(status, files): what is indexed, new, changed and removed."""
    kinds = changes.groupBy(F.col("change").alias("status")).agg(F.count("*").alias("files"))
    return state.agg(F.lit("indexed").alias("status"), F.count("*").alias("files")).unionByName(kinds)
