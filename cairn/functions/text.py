"""Column expressions over names, texts and sketches. None of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it; Java's \s is ASCII only.
UNICODE_SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]+"
#: Words (letters, digits, underscore of any script, not starting with a digit) and single other characters.
TOKEN = r"[A-Za-z_][\p{L}\p{N}_]*|[^\s\x0b\x1c-\x1f\x85\xa0  -     　A-Za-z_]"
SKETCH_SIZE = 48
SKETCH_MASK = (1 << 48) - 1
#: One XOR constant for each permutation of the 48-bit shingle hashes.
SKETCH_SALTS = [seed * 0x9E3779B97F4A7C15 & SKETCH_MASK for seed in range(SKETCH_SIZE)]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest16(x: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 16)


def coord_id(qualname: Column | str, salt: Column | str | None = None, digits: int = 6) -> Column:
    """"C-" and six hex digits of the name's SHA-256, salted where ids collide."""
    name = col(qualname)
    return F.concat(F.lit("C-"), F.substring(F.sha2(name if salt is None else F.concat(name, col(salt)), 256), 1, digits))


def body_hash(text: Column | str) -> Column:
    """Digest of a text without any white space: layout doesn't change it."""
    return digest16(F.regexp_replace(col(text), UNICODE_SPACE, ""))


def comment_hash(comments: Column | str) -> Column:
    """Digest of the comments' own digests (or texts); "" without comments."""
    c = col(comments)
    parts = F.transform(c, lambda x: F.coalesce(F.nullif(x["h"], F.lit("")), x["text"]))
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit("")).otherwise(digest16(F.array_join(parts, "\n")))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0))


def shingles(tokens_: Column | str, n: int = 3) -> Column:
    """Distinct runs of n tokens joined by NUL; the whole list is one run where it is shorter."""
    t = col(tokens_)
    last = F.greatest(F.size(t) - n, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(t, i + 1, n), "\0")))


def hash48(x: Column) -> Column:
    """First 48 bits of MD5, as a BIGINT."""
    return F.conv(F.substring(F.md5(x), 1, 12), 16, 10).cast("long")


def sketch(hashes: Column | str) -> Column:
    """Minimum of the hashes under each of the 48 XOR permutations; empty for no hashes."""
    h = col(hashes)
    salts = F.array(*[F.lit(k).cast("long") for k in SKETCH_SALTS])
    full = F.transform(salts, lambda k: F.array_min(F.transform(h, lambda s: s.bitwiseXOR(k))))
    return F.when(F.size(h) > 0, full).otherwise(F.array().cast("array<bigint>"))


def sketch_of(text: Column | str) -> Column:
    return sketch(F.array_distinct(F.transform(shingles(tokens(text)), hash48)))


def sketch_jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of equal places; 0 where either sketch is empty."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda t: t))
    return F.when(n > 0, equal.cast("double") / n).otherwise(F.lit(0.0))


def sketch_containment(jaccard: Column, n_child: Column | str, n_parent: Column | str) -> Column:
    """Estimated share of the child's shingles that the parent holds."""
    c, p = col(n_child), col(n_parent)
    shared = jaccard / (1.0 + jaccard) * (c + p)
    return F.when((jaccard > 0) & (c > 0), F.least(F.lit(1.0), shared / F.when(c > 0, c).otherwise(1))).otherwise(F.lit(0.0))


def encode_sketch(values: Column | str) -> Column:
    """Six big-endian bytes a value, in base64."""
    digits = F.transform(col(values), lambda v: F.lpad(F.hex(v), 12, "0"))
    return F.base64(F.unhex(F.array_join(digits, "")))


def decode_sketch(packed: Column | str) -> Column:
    """Values of encode_sketch; empty where the input isn't whole base64 of six-byte values."""
    digits = F.hex(F.try_to_binary(col(packed), F.lit("base64")))
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(0), F.greatest(n / 12 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substr(digits, i * 12 + 1, F.lit(12)), 16, 10).cast("long"))
    return F.when((n > 0) & (n % 12 == 0), values).otherwise(F.array().cast("array<bigint>"))


def size_ratio(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.least(a, b).cast("double") / F.greatest(a, b, F.lit(1))


def render_ref(base: Column, arity: Column | None = None, occurrence: Column | None = None) -> Column:
    """base[/arity][#occurrence]; nulls leave a part out."""
    out = base
    if arity is not None:
        out = F.concat(out, F.coalesce(F.concat(F.lit("/"), arity.cast("string")), F.lit("")))
    if occurrence is not None:
        out = F.concat(out, F.when(occurrence > 1, F.concat(F.lit("#"), occurrence.cast("string"))).otherwise(F.lit("")))
    return out


def base_of(ref: Column | str) -> Column:
    """A reference without the arity or occurrence of its last segment."""
    return F.regexp_replace(col(ref), r"[/#][^.]*$", "")


def short_of(ref: Column | str) -> Column:
    return F.element_at(F.split(base_of(ref), r"\."), -1)


def arity_of(ref: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(ref), r"/(\d+)(?:#[^.]*)?$", 1), F.lit("")).try_cast("int")


def excerpt(text: Column | str, needle: Column | str, width: int = 160) -> Column:
    """Flattened window of the text around the first case-insensitive hit, with ellipses where cut."""
    flat = F.trim(F.regexp_replace(col(text), UNICODE_SPACE, " "))
    at = F.position(F.lower(col(needle)), F.lower(flat))
    begin = F.greatest(F.lit(1), at - width // 2)
    window = F.substr(flat, begin, F.lit(width))
    head = F.when(begin > 1, F.lit("…")).otherwise(F.lit(""))
    tail = F.when(begin + width - 1 < F.length(flat), F.lit("…")).otherwise(F.lit(""))
    return F.concat(head, window, tail)


def verdict(text: Column | str) -> Column:
    """struct(ref, verdict) of a line "VERDICT <#number or sha>: words"; null parts otherwise."""
    pattern = r"^VERDICT (#\d{1,7}|[0-9a-f]{7,40}): (.*)$"
    part = lambda k: F.nullif(F.regexp_extract(col(text), pattern, k), F.lit(""))
    return F.struct(part(1).alias("ref"), part(2).alias("verdict"))


def issue_refs(text: Column | str) -> Column:
    """Sorted distinct issue numbers, as struct(all, shaped): shaped ones are written the way forges write them."""
    every = F.array_sort(F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"#(\d{1,7})\b"), F.lit(1))))
    shaped = F.array_sort(F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"(?:\(|PR |Merge pull request )#(\d{1,7})\b"), F.lit(1))))
    return F.struct(every.alias("all"), shaped.alias("shaped"), F.array_except(every, shaped).alias("ambiguous"))


def backtick_refs(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"`([A-Za-z_][\p{L}\p{N}_.]*)`"), F.lit(1))))


def contract_words(name: Column | str) -> Column:
    """Distinct words of a test's name after "test"; empty for other names."""
    rest = F.regexp_extract(F.lower(col(name)), r"^test_?(.+)$", 1)
    return F.array_distinct(F.filter(F.split(F.regexp_replace(rest, "_", " "), r"\s+"), lambda x: x != ""))


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.to_json(x)) / 4).cast("int"))


def payload_bytes(x: Column) -> Column:
    return F.octet_length(F.to_json(x))


def regex_complexity(text: Column | str) -> Column:
    """1 and the branching words and operators of a C-like text."""
    return F.lit(1) + F.regexp_count(col(text), F.lit(r"\b(?:if|else if|for|while|case|catch|\?\?|&&|\|\|)\b|\?"))


_TEST_PARTS = ("tests", "test", "__tests__")


def is_test_path(path: Column | str) -> Column:
    """Whether a path is a test: by a directory on it, or by its file name's form. Names never matter."""
    p = F.regexp_replace(col(path), r"\\", "/")
    name = F.element_at(F.split(p, "/"), -1)
    by_dir = F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, _TEST_PARTS)))
    by_name = (
        F.when(name.endswith(".py"), name.startswith("test_") | name.endswith("_test.py"))
        .when(name.endswith(".go"), name.endswith("_test.go"))
        .when(name.rlike(r"\.[jt]sx?$"), F.contains(name, F.lit(".test.")) | F.contains(name, F.lit(".spec.")))
        .when(name.endswith(".java"), name.rlike(r"Tests?\.java$"))
        .otherwise(F.lit(False))
    )
    return by_dir | by_name


def is_runnable_test(path: Column | str, kind: Column | str, qualname: Column | str) -> Column:
    """A Python test function whose enclosing names within the file all start with Test."""
    parts = F.split(col(qualname), r"\.")
    inside = F.slice(parts, F.size(F.split(module_of(path), r"\.")) + 1, F.size(parts))
    outer = F.slice(inside, 1, F.greatest(F.size(inside) - 1, F.lit(0)))
    name = F.element_at(F.split(col(path), "/"), -1)
    collected = name.rlike(r"^test_.*\.py$|_test\.py$")
    return is_test_path(path) & collected & col(kind).isin("function", "method") & short_of(qualname).startswith("test") & F.forall(outer, lambda x: x.startswith("Test"))


def module_of(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(path), r"\.[^./]*$", ""), r"[/\\]", ".")


def test_node(path: Column | str, qualname: Column | str) -> Column:
    """path::Outer::name, the runner's name of a test."""
    module = module_of(path)
    inside = F.when(col(qualname).startswith(F.concat(module, F.lit("."))), F.substr(col(qualname), F.length(module) + 2)).otherwise(col(qualname))
    return F.concat(col(path), F.lit("::"), F.regexp_replace(inside, r"\.", "::"))


def locator(text: Column | str) -> Column:
    """struct(path, line) of "path:line"; leading "./" is taken off as one prefix, so dot-directories stay."""
    parts = lambda k: F.nullif(F.regexp_extract(col(text), r"^(.*):(\d+)$", k), F.lit(""))
    return F.struct(F.regexp_replace(parts(1), r"^(\./)+", "").alias("path"), parts(2).try_cast("int").alias("line"))


def tree_hash(lines: Column) -> Column:
    """Digest of a set of "mode blob path" lines, whatever their order."""
    return digest16(F.array_join(F.array_sort(lines), "\n"))


def accepted_hashes(logic: Column | str, body: Column | str) -> Column:
    """Digests under which a note counts as current."""
    return F.array_distinct(F.array_remove(F.array(F.coalesce(col(logic), F.lit("")), F.coalesce(col(body), F.lit(""))), ""))


def write_stamp(logic: Column | str, body: Column | str) -> Column:
    """The digest a new note is stamped with: behaviour first."""
    return F.coalesce(F.nullif(col(logic), F.lit("")), col(body))
