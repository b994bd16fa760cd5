"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a stored description may have, and characters looked at to tell binary from text.
MAX_DESCRIPTION, SNIFFED = 64 * 1024, 8192
#: Characters of a chunk of paragraphs.
CHUNK_CHARS = 12_000

# File extensions by kind (fixed values).
FILE_KINDS = {
    "text": ("txt", "md", "markdown", "csv", "tsv", "json", "jsonl", "ndjson", "triples", "xml", "html", "htm", "yaml", "yml", "log", "rtf"),
    "image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tif", "tiff"),
    "docx": ("docx",),
    "pdf": ("pdf",),
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda x: x != "")


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of the lower-cased text."""
    t = F.lower(text)
    n = F.length(t)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def humanize(name: Column) -> Column:
    """``signedBy`` and ``signed_by`` as ``signed by``."""
    return F.lower(F.regexp_replace(F.translate(name, "_", " "), "([a-z0-9])([A-Z])", "$1 $2"))


def mask_key(key: Column) -> Column:
    """First three and last four characters of a trimmed secret; empty for none."""
    k = F.trim(key)
    return F.when(F.length(k) == 0, F.lit("")).otherwise(F.concat(F.substring(k, 1, 3), F.lit("..."), F.right(k, F.lit(4))))


def infer_concept_type(file_stem: Column) -> Column:
    """``line_items`` as ``LineItem``: words in title case, one final s taken off."""
    words = F.filter(F.split(file_stem, r"[-_ ]"), lambda w: w != "")
    title = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    joined = F.array_join(title, "")
    return F.when(F.endswith(joined, F.lit("s")) & (F.length(joined) > 1), F.substr(joined, F.lit(1), F.length(joined) - 1)).otherwise(joined)


def file_kind(path: Column) -> Column:
    """What is done with an uploaded file by its extension; ``passthrough`` if none fits."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return reduce(lambda out, kv: F.when(extension.isin(*kv[1]), F.lit(kv[0])).otherwise(out), FILE_KINDS.items(), F.lit("passthrough"))


def looks_binary(text: Column) -> Column:
    """A NUL, or a tenth of control and replacement characters, among the first 8192 characters."""
    head = F.substring(text, 1, SNIFFED)
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F�]", ""))
    return F.coalesce(F.when(F.length(head) == 0, F.lit(False)).otherwise((F.instr(head, "\0") > 0) | (odd * 10 >= F.length(head))), F.lit(False))


def bounded_description(text: Column, limit: int = MAX_DESCRIPTION) -> Column:
    """The text, or as many whole characters as fit in ``limit`` bytes and an ellipsis; a marker for binary content.

    Found by halving on the byte length of prefixes, since bytes grow with characters.
    """
    steps = range(limit.bit_length() - 1, -1, -1)
    fits = F.aggregate(F.array(*[F.lit(1 << k) for k in steps]), F.lit(0), lambda n, step: F.when(F.octet_length(F.substr(text, F.lit(1), n + step)) <= limit, n + step).otherwise(n))
    cut = F.concat(F.substr(text, F.lit(1), fits), F.lit("…"))
    return F.when(looks_binary(text), F.lit("[binary content — text extraction unavailable]")).when(F.octet_length(text) <= limit, text).otherwise(cut)


def paragraph_chunks(text: Column, budget: int = CHUNK_CHARS) -> Column:
    """Paragraphs packed in order into chunks of at most ``budget`` characters; a longer paragraph stays whole."""
    pieces = F.split(text, "\n\n")

    def pack(chunks: Column, p: Column) -> Column:
        last = F.coalesce(F.get(chunks, F.size(chunks) - 1), F.lit(""))
        before = F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))
        full = (last != "") & (F.length(last) + F.length(p) + 2 > budget)
        return F.when(full, F.concat(chunks, F.array(p))).otherwise(F.concat(before, F.array(F.when(last == "", p).otherwise(F.concat(last, F.lit("\n\n"), p)))))

    packed = F.filter(F.aggregate(pieces, F.array().cast("array<string>"), pack), lambda c: c != "")
    return F.when(F.length(text) <= budget, F.array(text)).otherwise(packed)


def cited_ids(answer: Column) -> Column:
    """Sorted distinct numbers of the first line that begins with ``cited:`` among the first five; empty if none."""
    head = F.slice(F.split(F.trim(answer), "\n"), 1, 5)
    line = F.get(F.filter(head, lambda x: F.lower(F.ltrim(x)).startswith("cited:")), F.lit(0))
    found = F.regexp_extract_all(line, F.lit(r"([0-9]+)"), F.lit(1))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("bigint")))), F.array().cast("array<bigint>"))


def answer_text(answer: Column) -> Column:
    """The trimmed answer without its citation line and, where there is one, a leading ``Answer:``."""
    t = F.trim(answer)
    lines = F.split(t, "\n")
    cites = F.transform(F.slice(lines, 1, 5), lambda x: F.lower(F.ltrim(x)).startswith("cited:"))
    at = F.array_position(cites, F.lit(True))
    rest = F.trim(F.array_join(F.filter(lines, lambda x, i: i + 1 != at), "\n"))
    return F.when(at > 0, F.regexp_replace(rest, "^[Aa]nswer:\\s*", "")).otherwise(t)


_DIRECTIVE = r"^\s*@(concept_type|concept|relation_type|relation|rule|action)(?:\s+(.*))?$"


def directive_lines(body: Column) -> Column:
    """(line_no, tag, rest) of the lines of a text that are directives; a tag ends at white space or the line's end.

    Final commas and semicolons of the rest are taken off.
    """
    lines = F.filter(F.transform(F.split(body, "\r?\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda x: x["line"].rlike(_DIRECTIVE))
    return F.transform(
        lines,
        lambda x: F.struct(
            x["line_no"].alias("line_no"),
            F.regexp_extract(x["line"], _DIRECTIVE, 1).alias("tag"),
            F.trim(F.regexp_replace(F.trim(F.regexp_extract(x["line"], _DIRECTIVE, 2)), r"[,;]+$", "")).alias("rest"),
        ),
    )


def strip_fences(text: Column) -> Column:
    """The inside of a Markdown code fence if the text is one, else the text."""
    t = F.trim(text)
    inner = F.trim(F.regexp_replace(F.regexp_replace(t, "^```(json)?\\s*", ""), "(```)+\\s*$", ""))
    return F.when(t.startswith("```"), inner).otherwise(t)


def json_block(reply: Column) -> Column:
    """The first balanced ``{...}`` of a reply, strings with escapes respected; null if there is none.

    A byte order mark, white space and one code fence around it are taken off first.
    """
    bare = F.regexp_replace(reply, r"^\x{FEFF}*\s*(?:```(?:json)*\n*)?", "")
    start = F.instr(bare, "{")
    body = F.when(start > 0, F.substr(bare, start))
    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        plain = ~s["inside"]
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        inside = F.when(c == '"', plain | s["escaped"]).otherwise(s["inside"])
        escaped = s["inside"] & (c == "\\") & ~s["escaped"]
        end = F.when((s["end"] == 0) & plain & (c == "}") & (depth == 0), s["at"] + 1).otherwise(s["end"])
        return F.struct(depth.alias("depth"), inside.alias("inside"), escaped.alias("escaped"), (s["at"] + 1).alias("at"), end.alias("end"))

    end = F.aggregate(F.split(body, ""), begin, step)["end"]
    return F.when(end > 0, F.substr(body, F.lit(1), end))
