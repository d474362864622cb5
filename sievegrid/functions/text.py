"""Text rules as column expressions; every pattern also runs in RE2, so SQL engines give the same result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?"
QUERY_TOKEN = r"[\p{L}\p{N}_]+[\p{L}\p{N}_-]*"
HAN = "[一-鿿]"
HAN_OR_LATIN = "[一-鿿]+|[a-zA-Z0-9_-]+"
FILTER = r"([\p{L}\p{N}_]+):([^\s]+)"

# Words that are no keywords.
STOPWORDS = (
    "如何 怎么 怎样 什么 哪个 哪些 为什么 为何 谁 多少 几 是否 能否 可否 的 地 得 了 着 过 吗 呢 吧 啊 呀 在 于 和 与 或 及 并 而 但 但是 因为 所以 如果 那么 虽然 然而"
    " 我 你 他 她 它 我们 你们 他们 这 那 这个 那个 这些 那些 这里 那里 很 非常 特别 更 最 都 也 还 又 再 已 已经 正在 将 会 能 可以 应该 必须 是 有 做 进行 使用 通过 个 种 类 ？ 。 ！ ， 、"
    " a an the in on at to for of with by from as into about through between after before and or but if then because while although"
    " i you he she it we they this that these those what which who whom whose is am are was were be been being have has had do does did will would could should may might must can"
    " get use make how why when where not no yes so very just also too"
).split()

# Fixed value: short names of filter keys.
ALIASES = {"collection": "collection", "col": "collection", "c": "collection", "type": "doc_type", "doc_type": "doc_type", "t": "doc_type", "source": "source_path", "src": "source_path", "s": "source_path", "tag": "tags", "tags": "tags"}


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def collapse(c) -> Column:
    """Runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def index_tokens(c) -> Column:
    """Lower-cased index terms of at least two characters; null gives null, a blank text an empty array."""
    return F.filter(extract_all(F.lower(col(c)), INDEX_TOKEN), lambda t: F.length(t) >= 2)


def without_filters(c) -> Column:
    """The query text without its ``key:value`` parts."""
    return collapse(F.regexp_replace(collapse(c), FILTER, " "))


def filter_pairs(c) -> Column:
    """Array of ``(key, value)`` of the ``key:value`` parts, short keys written out."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    pairs = F.arrays_zip(extract_all(collapse(c), FILTER, 1).alias("k"), extract_all(collapse(c), FILTER, 2).alias("v"))
    return F.transform(pairs, lambda p: F.struct(F.coalesce(F.element_at(names, F.lower(p["k"])), p["k"]).alias("key"), p["v"].alias("value")))


def filter_map(c) -> Column:
    """The ``key:value`` parts as a map; of a repeated key the last counts."""
    pairs = filter_pairs(c)
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])))


def query_tokens(c) -> Column:
    """Query tokens in order, case kept; tokens with Han characters fall apart into Han and Latin runs."""
    parts = F.transform(extract_all(col(c), QUERY_TOKEN), lambda t: F.when(t.rlike(HAN), extract_all(t, HAN_OR_LATIN)).otherwise(F.array(t)))
    return F.flatten(parts)


def edited_stopwords(added=(), removed=()) -> list[str]:
    return [*(w for w in STOPWORDS if w not in set(removed)), *added]


def keywords(c, most: int = 20, match_case: bool = False, stopwords=STOPWORDS) -> Column:
    """Keywords of a query: tokens that are no stopwords, each once whatever its case, the first ``most``; lower-cased unless ``match_case``."""
    kept = F.filter(query_tokens(without_filters(c)), lambda t: ~F.lower(t).isin(list(stopwords)))
    low = F.transform(kept, F.lower)
    once = F.filter(kept, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    out = F.slice(once, 1, most)
    return out if match_case else F.transform(out, F.lower)


def fingerprint(c) -> Column:
    return F.sha2(F.lower(collapse(c)), 256)


def snippet(c, most: int = 200) -> Column:
    """The collapsed text, cut behind the last whole word within ``most`` characters with ``...`` where it is longer."""
    s = collapse(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, most), " [^ ]*$", ""), F.lit("...")))


def chunk_id(doc, index, text) -> Column:
    """The document id, the index padded to four digits (longer ones stay whole), and the start of the text's hash."""
    return F.concat(col(doc), F.lit("_"), F.lpad(col(index).cast("string"), F.greatest(F.lit(4), F.length(col(index).cast("string"))), F.lit("0")), F.lit("_"), F.substring(F.sha2(col(text), 256), 1, 8))


def title(c) -> Column:
    """Heading at the start, else a short first line without end mark, else the first sentence, else the first 100 characters."""
    t = col(c)
    head = F.trim(F.regexp_extract(t, r"^#{1,6}\s+([^\n]+)", 1))
    line = F.trim(F.substring_index(t, "\n", 1))
    first = F.regexp_replace(F.trim(F.regexp_replace(t, r"(?s)[.!?]\s.*$", "")), r"[.!?]+$", "")
    return (
        F.when(t.isNull() | (t == ""), "Untitled")
        .when(t.rlike(r"^#{1,6}\s+[^\n]"), head)
        .when((line != "") & (F.length(line) <= 100) & ~line.rlike("[.,;]$"), line)
        .when(first != "", F.when(F.length(first) <= 150, first).otherwise(F.concat(F.substring(first, 1, 147), F.lit("..."))))
        .otherwise(F.concat(F.trim(F.substring(t, 1, 100)), F.when(F.length(t) > 100, "...").otherwise("")))
    )


def summary(c, sentences: int = 3) -> Column:
    """The first sentences, at most 500 characters."""
    s = F.trim(F.array_join(F.slice(F.split(col(c), r"(?<=[.!?])\s+"), 1, sentences), " "))
    s = F.when(F.length(s) > 500, F.concat(F.substring(s, 1, 497), F.lit("..."))).otherwise(s)
    return F.coalesce(s, F.lit(""))


def tags(c, most: int = 10) -> Column:
    """Capitalised phrases, identifiers and emphasised terms, at most five of each, sorted."""
    # The three patterns.
    caps = F.slice(extract_all(c, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), 1, 5)
    names = F.slice(extract_all(c, r"\b[a-z]+(?:[A-Z][a-z]*)+\b|\b[a-z]+_[a-z_]+\b"), 1, 5)
    marks = F.transform(F.slice(extract_all(c, r"\*\*.+?\*\*|\*.+?\*|__.+?__|_.+?_"), 1, 5), lambda m: F.trim(F.regexp_replace(m, r"^(?:\*\*|\*|__|_)|(?:\*\*|\*|__|_)$", "")))
    found = F.filter(F.concat(caps, names, marks), lambda x: x != "")
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def refine(c) -> Column:
    """Page banners, comments, tags and surplus white space removed outside of code fences; null stays null."""
    def clean(s: Column) -> Column:  # the patterns are fixed values
        s = F.regexp_replace(s, r"(?is)─{10,}.*?(?:page \d+|footer|section \d+|©|confidential).*?─{10,}", "")
        s = F.regexp_replace(s, "─{10,}", "")
        s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", ""), "<[^>]+>", "")
        s = F.regexp_replace(F.regexp_replace(s, " {2,}", " "), r"\n{3,}", "\n\n")
        return F.regexp_replace(s, r"[^\S\n]+\n", "\n")

    # shields: every fence becomes a mark that the cleaning leaves alone, and comes back afterwards
    fences = extract_all(c, r"(?s)```.*?```")
    bare = clean(F.regexp_replace(col(c), r"(?s)```.*?```", "\u0001"))
    parts = F.split(bare, "\u0001", -1)
    back = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(fences, i), F.lit("")))), "")
    return F.regexp_replace(back, r"^\s+|\s+$", "")


def section_path(c) -> Column:
    """The parts of a section path, written as a JSON array or as ``a/b``, stripped; empty parts are left out, null has none."""
    raw = F.trim(col(c))
    parts = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, "/"))
    return F.coalesce(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def first_page(*cols) -> Column:
    """The first of several page columns, numbers or texts, that is set; null where it is no whole number."""
    return F.coalesce(*[col(c).cast("string") for c in cols]).try_cast("int")


def locator(first, last) -> Column:
    a, b = col(first), col(last)
    return F.when(a.isNull(), None).when(b.isNull() | (a == b), F.concat(F.lit("p. "), a.cast("string"))).otherwise(F.concat(F.lit("pp. "), a.cast("string"), F.lit("–"), b.cast("string")))


def merged_filters(parsed, explicit) -> Column:
    """Row predicates: explicit filters over parsed ones; the collection is a route, no predicate."""
    old = F.map_filter(col(parsed), lambda k, v: ~F.map_contains_key(col(explicit), k))
    return F.map_filter(F.map_concat(old, col(explicit)), lambda k, v: k != "collection")


def asset_references(text, figures, tables) -> Column:
    """``Figure n`` and ``Table n`` written as references to the n-th id of ``figures`` and ``tables``; unknown numbers stay."""
    def fold(t: Column, ids: Column, words: str, mark: str) -> Column:
        steps = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x, i: F.struct(x.alias("id"), (i + 1).cast("string").alias("n")))
        return F.aggregate(steps, t, lambda a, s: F.regexp_replace(a, F.concat(F.lit(rf"(?i)\b(?:{words})\s*"), s["n"], F.lit(r"(?!\d)")), F.concat(F.lit(f"[{mark}: "), s["id"], F.lit("]"))))

    return fold(fold(col(text), col(figures), r"figure|fig\.", "FIG_REF"), col(tables), "table", "TABLE_REF")


def citation_contexts(c, around: int = 40) -> Column:
    """Citation markers with up to ``around`` characters on either side, without overlap."""
    return extract_all(c, rf"(?s).{{0,{around}}}\[[0-9,\s]+\].{{0,{around}}}")
