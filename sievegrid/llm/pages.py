"""Text from scanned pages: page furniture, words broken across lines, misread words, and reflow."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize, spread
from .arrow import map_columns

# How a recogniser misreads letters. A sign stands for one of the letters given; a letter pair for one letter.
SIGNS = {"0": "o", "1": "li", "3": "e", "5": "s", "6": "b", "9": "g", "@": "a", "+": "t", "|": "li"}
PAIRS = {"ri": "n", "ii": "u", "rn": "m", "cl": "d", "li": "h", "vv": "w", "c": "e"}
#: Pairs of letters read as one.
MERGED = {"m": "rn", "d": "cl"}
HYPHENS = "-‐‑­¬"

_RULE_SIGNS = "-_=—–─*~•"
_RULE = re.compile(rf"(?:[{_RULE_SIGNS}]\s*){{3,}}")
_HEADING = re.compile(r"#{1,6}\s|\d+(?:\.\d+)+\.?\s+\S.{0,60}$")


def _misreadable(word: str) -> str:
    """A pattern that also matches the usual misreadings of ``word``."""
    back: dict[str, list[str]] = {}
    for seen, true in [*SIGNS.items(), *PAIRS.items()]:
        for c in true:
            back.setdefault(c, []).append(re.escape(seen))
    return "".join(f"(?:{'|'.join([re.escape(c), *back.get(c, [])])})" if c.isalpha() else re.escape(c) for c in word.lower())


_M = _misreadable
_PAGE = f"(?:{'|'.join(_M(w) for w in ('page', 'seite', 'página', 'p.', 's.', 'pág.'))})"
_OF = f"(?:{'|'.join(_M(w) for w in ('of', 'von', 'de', 'sur'))}|/)"
_SERIES = "|".join(_M(w) for w in ("annals of", "archive of", "archives of", "reports on", "letters on", "notes in", "notes on", "journal of", "proceedings of", "transactions on", "bulletin of", "advances in", "review of"))
#: Lines that are furniture wherever they stand.
_SURE = re.compile(
    rf"{_PAGE}\s*\d+(?:\s*{_OF}\s*\d+)?|[—–-]\s*\d{{1,4}}\s*[—–-]|\d{{1,4}}\s*/\s*\d{{1,4}}"
    rf"|{_PAGE}\s*\d+\s*\|.*|.*\|\s*{_PAGE}\s*\d+|(?:{_M('footer')}|{_M('header')}):.*|{_M('confidential')} ©.*|©\s*\d{{4}}.*|{_M('preprint')} - .*|.* - {_M('draft')} \d+"
    rf"|(?:{_SERIES}) .{{3,70}}\d\)?",
    re.IGNORECASE,
)
#: Lines that are furniture at the edge of a page or a blank line.
_EDGE = re.compile(rf"(?:{_SERIES}) .{{3,70}}|{_M('chapter')} \d+: .*", re.IGNORECASE)
_NUMBERED = re.compile(r"\d{1,4}\s{3,}\S.*|\S.*\s{3,}(?:·\s+)?\d{1,4}")
_BARE = re.compile(r"\d{1,4}|\[\d{1,4}\]|[ivxlcdm]{1,9}", re.IGNORECASE)


def classify(text: str) -> list[str]:
    """A role for every line of ``text``: ``blank``, ``furniture``, ``heading``, ``code``, ``table``, ``marker`` or ``text``."""
    lines = text.split("\n")
    bare = [s.strip() for s in lines]
    roles = []
    fence = False
    for z in bare:
        if z.startswith("```"):
            fence = not fence
            roles.append("code")
        elif fence:
            roles.append("code")
        elif not z:
            roles.append("blank")
        elif z[0] == "|":
            roles.append("table")
        elif z.startswith("[IMAGE:"):
            roles.append("marker")
        elif z[0] in _RULE_SIGNS and _RULE.fullmatch(z):
            roles.append("furniture")
        else:
            roles.append("text")

    def open_(i: int) -> bool:  # an edge: the text ends there, or a blank line or furniture follows
        return i < 0 or i >= len(lines) or roles[i] in ("blank", "furniture")

    def apart(i: int) -> bool:  # a number that no wrapping of the text puts on a line of its own
        last = roles[i - 1] == "text" and bare[i - 1] if i else ""
        if i + 1 < len(lines) and roles[i + 1] == "text":
            width = max(len(last or ""), len(bare[i + 1]))
            return bool(last) and width > 30 and len(bare[i]) + 1 + len(bare[i + 1].split()[0]) < width - 10
        return bool(last) and open_(i + 1) and last[-1] in ".!?" and any(c.isalpha() for c in last)

    found = "furniture" in roles
    for again in (0, 1):  # a second look, as furniture found below makes an edge above
        for i, z in enumerate(bare):
            if roles[i] != "text" or len(z) > 90:
                continue
            before, after = open_(i - 1), open_(i + 1)
            beside = i > 0 and roles[i - 1] == "furniture" or i + 1 < len(lines) and roles[i + 1] == "furniture"
            ended = z.endswith(".")
            # what hangs on the line alone was decided in the first look; the first letters and lengths are those the patterns ask for
            if (
                not again and not ended and (_SURE.fullmatch(z) or (z[0].isdecimal() or z[-1].isdecimal()) and _NUMBERED.fullmatch(z))
                or (before or after) and not ended and _EDGE.fullmatch(z)
                or len(z) < 10 and _BARE.fullmatch(z) and (before and after or beside and not z.isdigit() or apart(i))
                or z.endswith(" ...") and len(z) < 60 and ":" not in z and len(z.split()) > 3 and (i == 0 or beside or again and before and after and found)
            ):
                roles[i], found = "furniture", True
        if not found:  # nothing above has changed
            break
    if found:  # lines that come again from page to page
        masked = [re.sub(r"\d+", "9", z) if r == "text" else "" for z, r in zip(bare, roles)]
        often = Counter(m for m in masked if m)
        for i, m in enumerate(masked):
            if m and often[m] > 1 and len(m) < 80 and m[-1] not in ".,;:!?" and not _HEADING.match(m) and open_(i - 1) and open_(i + 1):
                roles[i] = "furniture"
    for i, z in enumerate(bare):
        if roles[i] == "text" and (z[0] == "#" or z[0].isdecimal()) and _HEADING.match(z) and (z[0] == "#" or open_(i - 1) and open_(i + 1)):
            roles[i] = "heading"
    return roles


# ---------------------------------------------------------------------------------------------- words

_INLINE = re.compile(r"`[^`\n]*`|\$[^$\n]{3,}\$|https?://\S+|\S+@\S+\.\w+")
_WORD = re.compile(r"[a-zß-öø-ÿœ013569@+|]*[a-zß-öø-ÿœ][a-zß-öø-ÿœ013569@+|]*")
_PLAIN = re.compile(r"[a-zß-öø-ÿœ]+")
_TERM = re.compile(r"[^\s`]+")
_CODED = re.compile(r"\d+(?:st|nd|rd|th|d|x|x\d+|k|m|s|h)|[a-z]{1,2}\d+[a-z]?|[0-9a-f]*\d[0-9a-f]*[a-f][0-9a-f]*\d[0-9a-f]*|[a-z]+\d+", re.IGNORECASE)
_EDGES = ".,;:!?…()[]{}<>\"'“”„»«’‘%*_/\\=~^&#·–—" + HYPHENS
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_JOINTS = re.compile(f"[{HYPHENS}/’']")
#: A hyphen at the end of a line.
_CUT = re.compile(rf"[{HYPHENS}]\s*\n")


def has_inline(text: str) -> bool:
    """Whether ``text`` may hold code, formulas or addresses, which are no words."""
    return "`" in text or "$" in text or "@" in text or "://" in text


def line_terms(line: str) -> list[str]:
    """What stands between blanks in a line of running text."""
    return _TERM.findall(_INLINE.sub(" ", line)) if has_inline(line) else line.split()


def term_words(term: str) -> list[str]:
    """Lower-cased Latin words of a term, with the signs that may stand for letters; parts of compounds one by one."""
    t = term.strip(_EDGES).lower()
    if not t or len(t) > 40:  # longer runs are data, not words
        return []
    return [part for part in (_JOINTS.split(t) if not t.isalpha() else (t,)) if _WORD.fullmatch(part)]


def line_words(line: str) -> list[str]:
    """The words of a line of running text."""
    return [w for t in line_terms(line) for w in term_words(t)]


def signs_in(word: str) -> int:
    return sum(c in SIGNS for c in word)


_STANDS_FOR = re.compile("|".join(re.escape(x) for x in [*SIGNS, *PAIRS, *MERGED]))


def may_be_misread(word: str) -> bool:
    """Whether the word holds a sign, or a letter or pair that stands for another or for two."""
    return _STANDS_FOR.search(word) is not None


@lru_cache(maxsize=1 << 16)
def misreadings(seen: str, true: str) -> int | None:
    """Least number of misreadings that turn ``true`` into ``seen``; null if it takes anything else."""
    if seen == true:
        return 0
    if not seen or not true:
        return None
    best = misreadings(seen[1:], true[1:]) if seen[0] == true[0] else None
    options = [(1, SIGNS.get(seen[0], "")), (2, PAIRS.get(seen[:2], "")), (1, PAIRS.get(seen[0], ""))]
    for width, letters in options:
        if true[0] in letters and len(seen) >= width:
            rest = misreadings(seen[width:], true[1:])
            if rest is not None and (best is None or rest + 1 < best):
                best = rest + 1
    if true.startswith(MERGED.get(seen[0], " ")):
        rest = misreadings(seen[1:], true[2:])
        if rest is not None and (best is None or rest + 1 < best):
            best = rest + 1
    return best


def plainly_misread(word: str) -> bool:
    """Signs in the place of letters, whatever the word: single signs inside at least four letters."""
    if _CODED.fullmatch(word) or sum(c.isalpha() for c in word) < 4:
        return False
    core = word.strip("".join(SIGNS))
    inside = [i for i, c in enumerate(core) if c in SIGNS]
    return bool(inside) and all(b - a > 1 for a, b in zip(inside, inside[1:])) and len(inside) * 2 < len(core)


class OddWords:
    """The words of a term that are not in ``known`` and may be misread. Answers of up to ``memory`` terms are kept, so that a term that comes again is not
    taken apart again; nothing else hangs on that number."""

    def __init__(self, known: set[str], memory: int = 1 << 17) -> None:
        self.known, self.memory = known, memory
        self.dull: set[str] = set()
        self.odd: dict[str, list[str]] = {}

    def of(self, terms: list[str]) -> set[str]:
        out: set[str] = set()
        for t in set(terms).difference(self.dull):
            if (ws := self.odd.get(t)) is None:
                ws = [w for w in term_words(t) if w not in self.known and may_be_misread(w)]
                if len(t) <= 64:  # longer ones fill the memory and hardly come again
                    if len(self.dull) + len(self.odd) >= self.memory:
                        self.dull, self.odd = set(), {}
                    if ws:
                        self.odd[t] = ws
                    else:
                        self.dull.add(t)
            out.update(ws)
        return out


class LevenshteinAutomaton:
    """Accepts the words within ``k`` edits of ``word``; states are rows of edit distances, made as they are reached."""

    def __init__(self, word: str, k: int) -> None:
        self.word, self.k = word, k
        self.start = tuple(min(i, k + 1) for i in range(len(word) + 1))
        self.made: dict[tuple[tuple[int, ...], str], tuple[int, ...] | None] = {}

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...] | None:
        """The next state, or null where no word can be accepted any more."""
        try:
            return self.made[state, c]
        except KeyError:
            pass
        row = [min(state[0] + 1, self.k + 1)]
        for i, w in enumerate(self.word):
            row.append(min(row[i] + 1, state[i + 1] + 1, state[i] + (w != c), self.k + 1))
        new = tuple(row) if min(row) <= self.k else None
        self.made[state, c] = new
        return new

    def distance(self, state: tuple[int, ...]) -> int:
        return state[-1]


def trie_of(words) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def within(trie: dict, word: str, k: int) -> list[tuple[str, int]]:
    """All words of the trie within ``k`` edits of ``word``: the intersection of the two automata."""
    auto = LevenshteinAutomaton(word, k)
    out, stack = [], [(trie, auto.start)]
    while stack:
        node, state = stack.pop()
        for c, below in node.items():
            if c == "":
                if auto.distance(state) <= k:
                    out.append((below, auto.distance(state)))
            elif (new := auto.step(state, c)) is not None:
                stack.append((below, new))
    return out


def true_forms(trie: dict, seen: str) -> list[tuple[str, int]]:
    """All words of the trie that misreading turns into ``seen``, with the least number of misreadings, however many: the trie is walked beside ``seen``,
    and a step takes a letter as it stands or undoes one misreading. A path ends where no word goes on, so its work is bounded by the words that begin so."""
    best: dict[str, int] = {}
    stack, end = [(trie, 0, 0)], len(seen)
    while stack:
        node, i, cost = stack.pop()
        if i == end:
            w = node.get("")
            if w is not None and cost < best.get(w, cost + 1):
                best[w] = cost
            continue
        c = seen[i]
        if c in node:
            stack.append((node[c], i + 1, cost))
        for t in SIGNS.get(c, "") + PAIRS.get(c, ""):
            if t in node:
                stack.append((node[t], i + 1, cost + 1))
        if i + 1 < end and (t := PAIRS.get(seen[i : i + 2])) in node:
            stack.append((node[t], i + 2, cost + 1))
        if (m := MERGED.get(c)) and m[1] in node.get(m[0], ()):
            stack.append((node[m[0]][m[1]], i + 1, cost + 1))
    return list(best.items())


# ---------------------------------------------------------------------------------------------- pipeline


def breaks(lines: list[str], roles: list[str]) -> list[tuple[int, int, str, str, str]]:
    """``(line, next line, left part, hyphen, right part)`` of the words that a hyphen carries over a line end. The next line is the next one of the
    running text; blank lines are skipped only together with furniture."""
    out = []
    for i, s in enumerate(lines):
        z = s.rstrip()
        if roles[i] != "text" or len(z) < 2 or z[-1] not in HYPHENS or not z[-2].isalnum():
            continue
        j = i + 1
        while j < len(lines) and roles[j] in ("blank", "furniture"):
            j += 1
        if j == len(lines) or roles[j] != "text" or (roles[i + 1] == "blank" and "furniture" not in roles[i + 1 : j]):
            continue
        left, right = re.search(r"[^\s(\[]*$", z[:-1])[0], re.match(r"[^\s,;:.!?)\]]*", lines[j].lstrip())[0]
        if re.search(r"[^\W\d_]", left) and re.match(rf"[{re.escape(''.join(SIGNS))}]?[^\W\d_]", right) and not right[0].isupper():
            out.append((i, j, left, z[-1], right))
    return out




def records(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``(record_table, record_key, text)`` of several tables, given as name -> (df, key, text); null texts and keys are left out, equal rows count once
    when results are distinct."""
    parts = [df.select(F.lit(n).alias("record_table"), F.col(k).cast("string").alias("record_key"), F.col(t).alias("text")) for n, (df, k, t) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return spread(out.where("text is not null and record_key is not null"))


def _scan(rows: DataFrame) -> DataFrame:
    """One pass over the texts: word counts per Arrow batch, furniture lines, and breaks with their two readings."""

    def run(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("record_table", "record_key", "line_no", "what", "word", "n")}

        def put(*row) -> None:
            for c, v in zip(out.values(), row):
                c.append(v)

        counts: Counter = Counter()
        # terms are counted as they stand, those of lines that are cut or hold code apart, and each different one is taken apart once
        plain: Counter = Counter()
        other: Counter = Counter()

        def take_apart() -> None:
            for often in (plain, other):
                for t, n in often.items():
                    for w in term_words(t):
                        counts[w] += n
                    if often is plain and "-" in t:
                        for w in _COMPOUND.findall(t.lower()):
                            counts[w] += n
                often.clear()

        for table, key, text in zip(b["record_table"], b["record_key"], b["text"]):
            roles, lines = classify(text), text.split("\n")
            broken = breaks(lines, roles)
            cut_end, cut_start = {x[0] for x in broken}, {x[1] for x in broken}
            terms: list[str] = []
            for i, (s, r) in enumerate(zip(lines, roles)):
                if r == "furniture":
                    put(table, key, i + 1, "furniture", None, None)
                elif r == "text":
                    cut = i in cut_start or i in cut_end
                    if not cut and not has_inline(s):
                        terms += s.split()
                        continue
                    whole = s.split()
                    other.update(line_terms(" ".join(whole[i in cut_start : len(whole) - (i in cut_end)]) if cut else s))
                    if "-" in s:
                        counts.update(_COMPOUND.findall(s.lower()))
            for i, _, left, sign, right in broken:
                put(table, key, i + 1, "break" if sign in "-‐‑" else "sure", f"{left}-{right}".lower(), None)
            plain.update(terms)
            if len(plain) + len(other) > 1 << 17:
                take_apart()
        take_apart()
        for w, n in counts.items():
            put(None, None, None, "word", w, n)
        return out

    return map_columns(rows, run, "record_table string, record_key string, line_no int, what string, word string, n bigint")


def true_prefixes(seen: str, n: int = 2) -> set[str]:
    """The first ``n`` letters of all words that misreading may turn into ``seen``; shorter where such a word ends before."""
    out, stack = set(), [("", 0)]
    while stack:
        head, i = stack.pop()
        if len(head) >= n or i == len(seen):
            out.add(head[:n])
            continue
        c = seen[i]
        for t in [*SIGNS.get(c, ""), *PAIRS.get(c, ""), *([c] if c not in SIGNS else []), *([MERGED[c]] if c in MERGED else [])]:
            stack.append((head + t, i + 1))
        if i + 1 < len(seen) and (t := PAIRS.get(seen[i : i + 2])):
            stack.append((head + t, i + 2))
    return out


def _candidates(suspects: DataFrame, vocabulary: DataFrame, shard: int = 20000) -> DataFrame:
    """``(seen, true, n_true, cost)``: words of the vocabulary that misreadings, however many and wherever, turn into a suspect.

    The vocabulary lies in shards by its first two letters; a suspect visits the shard of every two letters its start may stand
    for, so none that explains it is missed. Suspects of a shard with more than ``shard`` of them are dealt to several tasks, to which only that shard's words are repeated.
    """

    def spell(b: dict[str, list]) -> dict[str, list]:
        pairs = [(s, p) for s in b["seen"] for p in true_prefixes(s)]
        return {"seen": [s for s, _ in pairs], "head": [p for _, p in pairs]}

    legs = materialize(map_columns(suspects.select("seen"), spell, "seen string, head string"), "legs")
    per = broadcast_if_small(materialize(legs.groupBy("head").agg(F.ceil(F.count("*") / shard).cast("int").alias("salts")), "heads"), 40)
    s = legs.join(per, "head").select("head", "seen", F.pmod(F.xxhash64("seen"), "salts").cast("int").alias("salt"))
    v = vocabulary.select("true", "n_true", F.substring("true", 1, 2).alias("head")).join(per, "head")
    v = v.select("head", "true", "n_true", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            count = dict(zip(right["true"], right["n_true"]))
            trie = trie_of(count)
            for seen in left["seen"]:
                out += [(seen, w, count[w], cost) for w, cost in true_forms(trie, seen) if cost]
        return pd.DataFrame(out, columns=["seen", "true", "n_true", "cost"])

    return s.groupBy("head", "salt").cogroup(v.groupBy("head", "salt")).applyInPandas(match, "seen string, true string, n_true bigint, cost int")


def _without_names(damage: DataFrame, sign: str, sure: float = 0.5, z: float = 1.64) -> DataFrame:
    """Without words that only look misread: where a word without signs is, more often than not, the only thing wrong with its record, it is a word of its own,
    and stays a misreading only where its record has other damage. More often than not is a share of its occurrences whose lower confidence bound
    at ``z`` deviations reaches ``sure``, so neither a few chances nor the size of the corpus decide."""
    keys = ["record_table", "record_key"]
    per = damage.groupBy(*keys).agg(F.count(F.when(F.col("kind") != "misread", 1)).alias("others"), F.countDistinct(F.when(F.col("kind") == "misread", F.col("word"))).alias("n_words"))
    marked = damage.join(per, keys).withColumn("lone", (F.col("kind") == "misread") & ~F.coalesce(F.col("word").rlike(sign), F.lit(True)) & (F.col("others") == 0) & (F.col("n_words") == 1))
    each = marked.where("kind = 'misread'").groupBy("word").agg(F.count("*").alias("n"), F.count(F.when(F.col("lone"), 1)).alias("n_lone"))
    n, p, zz = F.col("n"), F.col("n_lone") / F.col("n"), z * z
    bound = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    return marked.join(each.where(bound >= sure).select("word", F.lit(True).alias("lone")), ["word", "lone"], "left_anti").select(*damage.columns)


def find_damage(rows: DataFrame, ratio: int = 8, common: int = 50000) -> tuple[DataFrame, DataFrame]:
    """Damaged lines and the readings of misread words in ``rows(record_table, record_key, text)``.

    Lines are ``(record_table, record_key, line_no, kind, word, fixed)``. ``furniture``: running headers, footers, page numbers and rules, by their form,
    by coming again, and, of numbers alone on a line, by a place where no wrapping puts them. ``broken_word``: a hyphen at the line end inside a word; soft hyphens always, others unless the compound with its hyphen is
    commoner in the corpus than the word without. ``misread``: a word with signs in place of letters, or a word that is rare and turns by usual misreadings into one
    at least ``ratio`` times as common; one with signs that turns into no word of the corpus counts in a line with at least three words of plain letters. Candidates are all
    words of the vocabulary (all words in running text of all rows) from which misreadings lead to the word, found on its trie; the fewest misreadings win, then the commoner word; ``fixed`` holds all of them, best first, and the repair
    lets the document's own words choose among them. A word that is as a rule the only damage of its record is left alone there. Only the ``common`` most frequent words, a fixed number, are held in
    every task, to pass over sound words quickly, which decides nothing else; all others are looked up by a join. Empty texts have no damage.
    """
    scan = materialize(_scan(rows), "scan")
    words = materialize(scan.where("what = 'word'").groupBy("word").agg(F.sum("n").alias("n")), "words")
    sign = "[" + "".join(re.escape(c) for c in SIGNS) + "]"
    plain = ~F.col("word").rlike(sign) & ~F.col("word").contains("-")
    vocabulary = words.where(plain).select(F.col("word").alias("true"), F.col("n").alias("n_true"))
    top = vocabulary.agg(F.max("n_true")).first()[0] or 0
    shaped = F.col("word").rlike("|".join([*PAIRS, *MERGED])) & (F.length("word") >= 4) & (F.col("n") * ratio <= top)
    suspects = words.where(~F.col("word").contains("-") & (F.length("word") <= 40) & ~F.col("word").rlike("^[a-z]{1,2}[0-9]+$") & ((F.col("word").rlike(sign) & (F.length("word") >= 2)) | (plain & shaped)))
    # a common word is no suspect: what it could be misread from would have to be commoner still
    suspects = materialize(suspects.select(F.col("word").alias("seen"), F.col("n").alias("n_seen")), "suspects")
    found = _candidates(suspects, vocabulary).join(suspects, "seen")
    found = found.where((F.col("n_true") >= F.col("n_seen") * ratio) | (F.col("seen").rlike(sign) & (F.col("n_true") >= F.col("n_seen"))))
    # a word that is itself misread stands for another only if no sound one does
    found = materialize(found, "found")
    found = found.join(found.select(F.col("seen").alias("true"), F.lit(True).alias("doubtful")).distinct(), "true", "left")
    each = F.array_sort(F.collect_list(F.struct(F.coalesce("doubtful", F.lit(False)).alias("doubtful"), "cost", (-F.col("n_true")).alias("m"), "true")))
    readings = found.groupBy("seen").agg(each.alias("each")).select("seen", F.transform(F.filter("each", lambda x: x["doubtful"] == F.col("each")[0]["doubtful"]), lambda x: x["true"]).alias("fixed"))
    readings = materialize(readings, "readings")

    sound = {r.word for r in words.where(plain).join(readings.select(F.col("seen").alias("word")), "word", "left_anti").orderBy(F.desc("n"), "word").limit(common).select("word").collect()}
    shared = rows.sparkSession.sparkContext.broadcast(sound)

    made: list[OddWords] = []  # one a task

    def lookup(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("record_table", "record_key", "line_no", "seen", "plainly")}
        if not made:
            made.append(OddWords(shared.value))
        odd = made[0].of
        for table, key, text in zip(b["record_table"], b["record_key"], b["text"]):
            if not has_inline(text) and not odd(text.split()) and not _CUT.search(text):
                continue  # no line of it can hold such a word, whatever its role
            roles, lines = classify(text), text.split("\n")
            broken = breaks(lines, roles)
            cut_end, cut_start = {x[0] for x in broken}, {x[1] for x in broken}
            joined = {i: line_words(left + right) for i, _, left, _, right in broken}
            for i, (s, r) in enumerate(zip(lines, roles)):
                if r != "text":
                    continue
                ws = None
                if i in cut_start or i in cut_end:
                    ws = line_words(s)
                    if i in cut_start:
                        ws = ws[1:]
                    if i in cut_end:
                        ws = ws[:-1] + joined[i]
                if not (found := odd(line_terms(s) if ws is None else ws)):
                    continue
                plain = {w for w in found if plainly_misread(w)}
                if plain and sum(len(w) > 1 and w.isalpha() for w in (line_words(s) if ws is None else ws)) <= 2:
                    plain = set()
                for w in found:
                    for c, v in zip(out.values(), (table, key, i + 1, w, w in plain)):
                        c.append(v)
        return out

    seen = map_columns(rows, lookup, "record_table string, record_key string, line_no int, seen string, plainly boolean")
    misread = seen.join(readings, "seen", "left").where("plainly or fixed is not null").select("record_table", "record_key", "line_no", F.lit("misread").alias("kind"), F.col("seen").alias("word"), "fixed")

    cut = scan.where("what in ('break', 'sure')").withColumn("whole", F.regexp_replace("word", "-", ""))
    as_is = words.select(F.col("word").alias("compound"), F.col("n").alias("n_compound"))
    as_one = words.select(F.col("word").alias("whole"), F.col("n").alias("n_whole"))
    # of a longer compound only the last joint is asked for
    cut = cut.withColumn("compound", F.regexp_extract("word", r"([^\W\d_]+-[^\W\d_]+)[^-]*$", 1))
    broken = (
        cut.join(as_is, "compound", "left").join(as_one, "whole", "left")
        .where("what = 'sure' or coalesce(n_compound, 0) <= coalesce(n_whole, 0)")
        .select("record_table", "record_key", "line_no", F.lit("broken_word").alias("kind"), "word", F.array("whole").alias("fixed"))
    )
    none = F.lit(None).cast("string")
    furniture = scan.where("what = 'furniture'").select("record_table", "record_key", "line_no", F.lit("furniture").alias("kind"), none.alias("word"), F.array(none).alias("fixed"))
    damage = materialize(misread.unionByName(broken).unionByName(furniture), "damage")
    return _without_names(damage, sign), readings


def repair(text: str, damage: list[dict]) -> str:
    """``text`` without its furniture, broken words joined, misread words replaced, lines of a paragraph put on one line.

    Headings, tables, code and markers keep their lines. Of several readings one that the text itself uses elsewhere is preferred. A paragraph cut by
    a page goes on behind it. Where words are replaced, a capital at the start of the word is kept.
    """
    lines, roles = text.split("\n"), classify(text)
    for d in damage:
        if d["kind"] == "furniture" and 0 < d["line_no"] <= len(lines):
            roles[d["line_no"] - 1] = "furniture"
    own = Counter(w for s, r in zip(lines, roles) if r == "text" for w in line_words(s))
    broken = {d["line_no"] - 1: d for d in damage if d["kind"] == "broken_word"}
    swaps: dict[int, dict[str, str]] = {}
    for d in damage:
        if d["kind"] == "misread" and d["fixed"]:
            swaps.setdefault(d["line_no"] - 1, {})[d["word"]] = max(d["fixed"], key=lambda w: own[w])
    out: list[str] = []
    para = ""
    glue, page_cut = "", False

    def flush() -> None:
        nonlocal para
        if para:
            out.append(para)
        para = ""

    for i, (s, r) in enumerate(zip(lines, roles)):
        if r == "furniture":
            page_cut = True
        elif r == "blank":
            if para and not page_cut and not (i + 1 < len(roles) and roles[i + 1] == "furniture") and glue != "":
                flush()
        elif r != "text":
            flush()
            if out and r in ("code", "table") and i and roles[i - 1] == r:
                out[-1] += "\n" + s
            else:
                out.append(s)
            page_cut = False
        else:
            z = s.strip()
            goes_on = bool(para) and (glue == "" or not page_cut or (para[-1] not in ".!?:。！？" and z[:1].islower()))
            if para and not goes_on:
                flush()
            page_cut = False
            if i in broken:
                z = z[:-1]
            para = para + (glue if para else "") + z
            glue = "" if i in broken or (z and z[-1] in HYPHENS) else " "
            for seen, true in swaps.get(i, {}).items():
                para = re.sub(rf"(?<![^\W\d_]){re.escape(seen)}(?![^\W\d_])", lambda m, t=true: t.capitalize() if m[0][:1].isupper() or i == 0 and not m[0][:1].isalpha() and para.startswith(m[0]) else t, para, flags=re.IGNORECASE)
    flush()
    return "\n\n".join(re.sub(r"[ \t]{2,}", " ", p) if "\n" not in p and not p.startswith("```") else p for p in out)


def repair_pages(rows: DataFrame, damage: DataFrame) -> DataFrame:
    """``(record_table, record_key, text, n_damaged)`` for every row of ``rows``: the repaired text and the number of its damaged lines. Damage is gathered per
    record, which one text bounds, and joined to the texts."""
    keys = ["record_table", "record_key"]
    notes = damage.groupBy(*keys).agg(F.collect_list(F.struct("line_no", "kind", "word", "fixed")).alias("damage"), F.countDistinct("line_no").alias("n_damaged"))

    def run(b: dict[str, list]) -> dict[str, list]:
        return {k: b[k] for k in keys} | {"text": [repair(t, x or []) for t, x in zip(b["text"], b["damage"])], "n_damaged": [n or 0 for n in b["n_damaged"]]}

    return map_columns(rows.join(notes, keys, "left"), run, "record_table string, record_key string, text string, n_damaged bigint")
