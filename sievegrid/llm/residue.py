"""Template residue, filler and error pages: TF-IDF containment of passage windows in labelled exemplars."""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .arrow import map_columns

SLOT = "⟦slot⟧"

# Labelled exemplars, one passage each; "_" stands for an unfilled slot.
EXEMPLARS: dict[str, tuple[str, ...]] = {
    "template": (
        "_ _ _ _", "title: _", "abstract: _", "keywords: _, _", "figure _: _", "submitted by _ on _", "operator _ ran batch _", "we thank _ for _",
        "_ was measured at _ with _", "the _ of _ is given in _", "contact _ for details on _", "dear _", "name: _ date: _", "version _ of _",
        "titel: _", "zusammenfassung: _", "stichwörter: _, _", "schlagwörter: _, _", "abbildung _: _", "eingereicht von _ am _", "_ wurde bei _ mit _ gemessen", "wir danken _ für _",
        "titre : _", "résumé : _", "mots-clés : _, _", "figure _ : _", "soumis par _ le _", "_ a été mesuré à _ avec _", "nous remercions _ pour _",
        "título: _", "resumen: _", "palabras clave: _, _", "figura _: _", "enviado por _ el _", "_ se midió a _ con _", "agradecemos a _ por _",
        "标题：_", "摘要：_", "关键词：_，_", "图 _：_", "由 _ 于 _ 提交", "_ 在 _ 下用 _ 测得", "感谢 _ 提供 _",
    ),
    "filler": (
        "text text text text", "test test test", "asdf asdf asdf", "qwerty qwerty", "xxx xxx xxx", "blah blah blah", "foo bar baz",
        "body copy goes here", "type something meaningful later", "sample text for layout only", "replace this paragraph with your own content",
        "this is dummy content used to fill the page", "click here to edit this text", "insert your text here", "add a description here",
        "heading placeholder to be written", "subheading example coming soon", "caption placeholder content pending", "paragraph example n/a yet",
        "heading subheading caption paragraph one two three: content pending, coming soon, to be written, n/a yet, tbd, todo",
        "platzhalter text folgt", "beispieltext für das layout", "blindtext", "texte à venir", "texte de remplacement", "texto de relleno", "texto de ejemplo", "此处填写内容", "示例文字", "占位文本", "内容待补充",
        "lorem ipsum dolor dolores sit amet consectetur consequa adipiscing adipis elit elitus sed do eiusmod tempor tempora incididunt incidens ut labore labora et dolore magna aliqua ad minim veniam venia quis nostrud"
        " exercitation exercit ullamco ullam laboris nisi aliquip ex ea commodo duis aute irure in reprehenderit voluptate velit velum esse cillum eu fugiat fugia nulla pariatur pariat excepteur sint occaecat cupidatat cupida non"
        " proident sunt culpa qui officia deserunt deserit mollit anim id est laborum ornatus sagittis sagit tegmentum lacus modum pellentesque pellent rumen integer integra cursus cursorem talis faucibus fauci vestibulum vesti"
        " suspendisse suspendo portus rutrum rutra gravida",
    ),
    "error": (
        "404 not found", "502 bad gateway", "403 forbidden", "500 internal server error", "503 service unavailable", "access denied", "service temporarily unavailable", "something went wrong on our side",
        "this page could not be loaded", "too many requests from your network", "the document you requested does not exist or was moved", "error: upstream returned no content",
        "an unexpected error occurred while rendering the article", "request timed out while contacting the repository", "the full text is not available to your institution", "your session has expired, sign in again",
        "please try again in a few minutes", "if the problem persists, tell the library desk", "go back to the start page or try the search", "return to the previous page", "incident", "reference no.",
        "at node render line", "error status code message request trace", "error code 404 reason", "status code 404 detail message", "page not found", "the page you are looking for does not exist", "bad request", "gateway timeout", "connection reset",
        "404 seite nicht gefunden", "zugriff verweigert", "interner serverfehler", "ihre sitzung ist abgelaufen", "die gesuchte seite existiert nicht mehr", "bitte versuchen sie es später erneut", "zurück zur startseite", "vorgang",
        "der dienst ist vorübergehend nicht verfügbar", "beim laden ist ein fehler aufgetreten",
        "erreur 404 : page introuvable", "accès refusé", "votre session a expiré", "une erreur est survenue lors du chargement", "service momentanément indisponible", "veuillez réessayer plus tard", "retour à l'accueil",
        "error 404: página no encontrada", "acceso denegado", "su sesión ha caducado", "se produjo un error al cargar el artículo", "servicio no disponible temporalmente", "inténtelo de nuevo más tarde", "volver al inicio", "incidencia",
        "404 页面不存在", "您没有访问权限", "服务器内部错误", "会话已过期，请重新登录", "请求超时，请稍后重试", "服务暂时不可用", "请返回首页", "如仍有问题请联系馆员", "事件编号",
    ),
    "scripts": (
        "please enable javascript to view this article", "you need to allow javascript and cookies to continue", "we are sorry, but the document viewer does not work without javascript enabled", "your browser blocks scripts; the viewer cannot start",
        "this reader needs scripts to be switched on", "turn on scripting in the settings of your browser, then reload", "checking that you are a human reader", "this may take a moment", "loading...", "verify that you are human", "this site uses cookies",
        "bitte aktivieren sie javascript, um diesen artikel zu lesen", "ohne skripte kann der leser nicht starten", "diese anzeige braucht aktive skripte", "bitte erlauben sie cookies und skripte, um fortzufahren",
        "veuillez activer javascript pour lire cet article", "ce lecteur exige l'exécution de scripts", "autorisez les cookies et les scripts pour continuer",
        "active javascript para leer este artículo", "este visor necesita que los scripts estén permitidos", "permita cookies y scripts para continuar",
        "请启用 javascript 以查看本文", "本阅读器需要允许脚本运行", "请允许脚本和 cookie 后继续",
    ),
    "frame": (
        "home about issues browse search contact help register log in menu sign up login logout back next previous share print download",
        "startseite suche hilfe anmelden registrieren kontakt menü", "accueil recherche aide connexion contact menu", "inicio buscar ayuda contacto menú", "首页 搜索 帮助 登录 注册 联系 菜单",
    ),
}

_FIELD = r"[^\W\d_][\w -]{1,40}?"
SLOTS = re.compile(
    rf"<<\s*{_FIELD}\s*>>|<%=?\s*{_FIELD}\s*%>|\{{\{{\s*{_FIELD}\s*\}}\}}|\{{%\s*{_FIELD}\s*%\}}|[$#]\{{\s*{_FIELD}\s*\}}|@@{_FIELD}@@|__{_FIELD}__|%{_FIELD}%"
    rf"|\[(?:INSERT|TBD|TODO|FILL|ENTER|ADD):?\s+{_FIELD}\]|\[Your {_FIELD} here\]|<{_FIELD} goes here>|\((?:enter|insert|add) {_FIELD}\)|\bXX {_FIELD} XX\b|\[\[{_FIELD}\]\]",
    re.IGNORECASE,
)
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.IGNORECASE)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.DOTALL)
_MARKER = re.compile(r"\[IMAGE:[^\]]*\]")
_WINDOW = re.compile(r"\n+|(?<=[.!?…])\s+|(?<=[。！？])|\s[|>]\s")
_LABEL = re.compile(r"\s+(?=[^\W\d_][\w-]*\s?[:：])")
_TOKEN = re.compile(r"⟦slot⟧|[㐀-鿿]+|[^\W\d_]+|\d[\d.,:-]*")
_ID = re.compile(r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{6,}\b", re.IGNORECASE)


def tokens(text: str) -> list[str]:
    """Lower-cased words, pairs of neighbouring Han characters, ``9`` for numbers; runs of one letter count as ``xxx``."""
    out = []
    for w in _TOKEN.findall(text.lower()):
        c = w[0]
        if "㐀" <= c <= "鿿":
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        elif c.isdigit():
            out.append("9")
        elif len(w) > 2 and w == c * len(w):
            out.append("xxx")
        else:
            out.append(w)
    return out


def windows(text: str) -> tuple[list[str] | None, bool, list[list[str]]]:
    """The heading in the first line, whether the text is one line that begins with a heading, and token lists of its sentences and lines.
    Unfilled slots become one token each, mark-up, identifiers and the image markers of the project are taken out. Where the heading of a
    text on one line ends is not known, so it is part of the first sentence. A code block is one window."""
    text = _MARKER.sub(" ", text)
    code = [re.findall(r"\w+", m.lower()) for m in _FENCE.findall(text)]
    body = _FENCE.sub("\n", text)
    body = SLOTS.sub(f" {SLOT} ", body)
    body = _ID.sub(" ", _TAG.sub("\n", body)).strip()
    head, titled = None, body.startswith("#")
    if titled and "\n" in body:
        first, _, body = body.partition("\n")
        head, titled = tokens(first), False
    if SLOT in body:
        body = _LABEL.sub("\n", body)
    return head, titled, [t for t in (tokens(w) for w in _WINDOW.split(body)) if t] + [c for c in code if c]


BUILT_IN = [(label, p) for label, passages in EXEMPLARS.items() for p in passages]


def _form(passage: str) -> list[str]:
    return tokens(re.sub(r"(?<!\w)_(?!\w)", SLOT, passage))


class Exemplars:
    """Inverted index of labelled exemplars: term -> exemplars, with the IDF of every term."""

    def __init__(self, n_docs: int, df: dict[str, int], unseen: float, passages: list[tuple[str, str]] = BUILT_IN) -> None:
        self.unseen = unseen
        self.labels: list[str] = []
        self.empty: list[int] = []
        post: dict[str, set[int]] = defaultdict(set)
        for label, p in passages:
            ts = _form(p)
            for t in ts:
                post[t].add(len(self.labels))
            self.labels.append(label)
            self.empty.append(ts.count(SLOT))
        self.post = {t: sorted(x) for t, x in post.items()}
        self.idf = {t: min(unseen, math.log(1 + n_docs / (1 + df.get(t, 0)))) for t in post}
        self.idf[SLOT] = unseen
        self.weight, self.own = [0.0] * len(self.labels), [0.0] * len(self.labels)
        for t, es in self.post.items():
            for e in es:
                self.weight[e] += self.idf[t]
                self.own[e] += self.idf[t] * (t != SLOT)

    def slots(self, window: list[str], share: float) -> tuple[int, int] | None:
        """Unfilled and filled slots of the exemplar with slots of whose own words the window holds the most weight, if it holds ``share`` of them."""
        held: dict[int, float] = defaultdict(float)
        for t in set(window) - {SLOT}:
            for e in self.post.get(t, ()):
                if self.empty[e]:
                    held[e] += self.idf[t]
        if not held:
            return None
        e = max(held, key=lambda i: (held[i] >= share * self.own[i], held[i], -i))
        empty = window.count(SLOT)
        return (empty, max(0, self.empty[e] - empty)) if held[e] >= share * self.own[e] else None

    def best(self, window: list[str], least: float) -> tuple[float, str | None]:
        """Weight of the window, and the label of the exemplar that holds the largest share of it, if that share reaches ``least``."""
        idf, unseen = self.idf, self.unseen
        total = known = 0.0
        for t in window:
            w = idf.get(t)
            if w is None:
                total += unseen
            else:
                total += w
                known += w
        if known < least * total:  # no exemplar can hold more than what any of them knows
            return total, None
        held: dict[int, float] = defaultdict(float)
        for t in window:
            for e in self.post.get(t, ()):
                held[e] += idf[t]
        if not held:
            return total, None
        e = max(held, key=lambda i: (held[i], -i))
        return total, self.labels[e] if held[e] >= least * total else None


    def span(self, window: list[str], containment: float) -> tuple[int, int, float, str] | None:
        """The stretch ``(start, end, weight, label)`` of the window with the most weight of one exemplar over that of all else, of which the exemplar holds
        at least ``containment``; it must hold half of the exemplar, or as much as two terms of no exemplar weigh, so common words alone are none."""
        each = [self.idf.get(t, self.unseen) for t in window]
        upto = [0.0]
        for w in each:
            upto.append(upto[-1] + w)
        at: dict[int, list[int]] = defaultdict(list)
        for i, t in enumerate(window):
            for e in self.post.get(t, ()):
                at[e].append(i)
        cost = containment / (1 - containment)  # with it a stretch of no net weight is held by just ``containment``
        found, most = None, 0.0
        for e, places in at.items():
            start, net, last = 0, 0.0, 0
            for i in places:
                net -= cost * (upto[i] - upto[last])
                if net <= 0:
                    start, net = i, 0.0
                net, last = net + each[i], i + 1
                if net > most:
                    own = {t: self.idf[t] for t in window[start:last] if e in self.post.get(t, ())}
                    if sum(own.values()) >= min(self.weight[e] / 2, 2 * self.unseen):
                        found, most = (start, last, upto[last] - upto[start], self.labels[e]), net
        return found

    def spans(self, window: list[str], containment: float) -> list[tuple[int, int, float, str]]:
        """Stretches of exemplars in the window that do not overlap, in their order, the weightiest taken first."""
        out, todo = [], [(0, len(window))]
        while todo:
            a, b = todo.pop()
            if a < b and (found := self.span(window[a:b], containment)):
                start, end, weight, label = found
                out.append((a + start, a + end, weight, label))
                todo += [(a, a + start), (a + end, b)]
        return sorted(out)


def residue_scores(
    df: DataFrame, id_col: str, text_col: str, containment: float = 0.5, unseen: float = 4.6, title: int = 12, exemplars: DataFrame | None = None, most_exemplars: int = 20000, form: float = 0.95
) -> DataFrame:
    """``(id, coverage, kind, n_windows)`` for every row with a text that holds a token.

    ``exemplars(label, passage)`` are the labelled passages, ``BUILT_IN`` without it; ``_`` stands for an unfilled slot, and the label ``frame`` marks menus. They are settings, no
    data: more than ``most_exemplars`` are an error. IDF of the exemplars' terms is counted over all rows; a term of no exemplar weighs ``unseen``.
    A window belongs to the exemplar that holds the largest share of its weight if that share reaches ``containment``. In a text with unfilled
    slots, a line that holds the share ``form`` of the weight of a template's own words counts by its unfilled slots against its filled ones, whatever they are filled with.
    A heading on a line of its own counts only if it belongs to an exemplar
    itself. In a text on one line, what belongs to no exemplar as a whole is searched for stretches of exemplars, as its parts have no ends of their own; where it begins with a heading, up to
    ``title`` words before the first stretch together weigh as one term of no exemplar, those beyond them in full. ``coverage`` is the weight of
    windows of residue over that of all windows but menus (``frame``); ``kind`` is the label with the most weight, null without residue.
    Rows are scored one by one and never shuffled; only the counts of the exemplars' own terms come to the driver.
    Null and blank texts give no row; repeated rows give one row each.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"\S"))
    rows = spread(rows)
    passages = BUILT_IN
    if exemplars is not None:
        passages = [(r.label, r.passage) for r in exemplars.where("label is not null and passage is not null").select("label", "passage").distinct().orderBy("label", "passage").limit(most_exemplars + 1).collect()]
        if len(passages) > most_exemplars:
            raise ValueError(f"more than {most_exemplars} exemplars")
    known = {t for _, p in passages for t in tokens(p)}

    def count(b: dict[str, list]) -> dict[str, list]:
        n: dict[str, int] = defaultdict(int)
        for t in b["text"]:
            for w in known.intersection(tokens(t)):
                n[w] += 1
        n[""] = len(b["text"])
        return {"term": list(n), "n": list(n.values())}

    counted = map_columns(rows.select("text"), count, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    df_of = {r.term: r.n for r in counted.collect()}
    index = Exemplars(df_of.pop("", 0), df_of, unseen, passages)

    def score(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "coverage", "kind", "n_windows")}
        for i, t in zip(b["id"], b["text"]):
            by: dict[str | None, float] = defaultdict(float)
            head, titled, ws = windows(t)
            if head and index.best(head, containment)[1] not in (None, "frame"):
                ws.insert(0, head)
            slotted, flat = any(SLOT in w for w in ws), titled or "\n" not in t.strip()
            for k, w in enumerate(ws):
                if slotted and (found := index.slots(w, form)):
                    by["template"] += unseen * found[0]
                    by[None] += unseen * found[1]
                    continue
                weight, label = index.best(w, containment)
                if label is None and flat:
                    inside = index.spans(w, containment)
                    for _, _, part, kind in inside:
                        by[kind] += part
                        weight -= part
                    if k == 0 and titled:
                        lead = [index.idf.get(x, unseen) for x in w[: inside[0][0] if inside else len(w)]][:title]
                        weight -= max(0.0, sum(lead) - unseen)
                by[label] += weight
            by.pop("frame", None)
            content = by.pop(None, 0.0)
            bad = sum(by.values())
            by = {k: v for k, v in by.items() if v}
            out["id"].append(i)
            out["coverage"].append(bad / (bad + content) if bad else 0.0)
            out["kind"].append(max(by, key=by.get) if bad else None)
            out["n_windows"].append(len(ws))
        return out

    return map_columns(rows, score, f"id {dict(rows.dtypes)['id']}, coverage double, kind string, n_windows int")
