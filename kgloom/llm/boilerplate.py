"""The main body of a page without its furniture (problem 2).

A page text is read as a tree: the page, its regions (before the title, the middle, after the
last long element), their groups (runs of short siblings; a long element is a group of its
own) and the leaves: lines, or in wrapped text the blocks between blank lines, whose lines
share their leaf's fate. Gradient-boosted trees score leaves and groups from features in the
manner of DOM classifiers: subtree density, attribute tokens, depth and place, statistics of
the siblings. Attribute tokens are of two kinds: fixed words of menus, notices, bars and the
like, and the odds of every token of the labelled sample, whatever its language. Hierarchical
decoding then picks the likeliest labelling of the tree in which no main leaf lies below a
discarded node and no kept node is empty.

The trees are fitted here, on the leaves of at most SAMPLE documents of at most LONGEST
characters (the first in order of a hash of their id); both bounds are parameters. Their
labels come from evidence that the trees don't see: how many pages of its site hold a leaf
(with its digits masked) and how often it stands at the edge of the page, counted over all
documents, and whether it is the title of another page of the site. Where that is silent, the
place before the title and the fixed words speak. Everything else is one map over all
documents, without a shuffle before the final distinct.

Defined results: null and blank texts have no line; a null title is no title; an unknown
source_type is read line by line; without a source_id there is no site to count over; rows
repeated with the same id count once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.session import spread

#: Labelled documents, and the longest of them: the sample has a proven size. All are classified whole.
SAMPLE, LONGEST = 800, 50_000
TREES, DEPTH, RATE, BINS = 32, 5, 0.3, 32
#: A leaf on so many pages of a site, and this share of them, recurs. A short one mostly at the edge of pages is furniture, one
#: mostly within them a heading, unless on MOST of the pages; a long one is furniture on COMMON of the pages.
RECURS, SHARE, COMMON, MOST, EDGE, INNER = 3, 0.005, 0.15, 0.5, 0.6, 0.2
#: Characters of a long leaf; leaves this long at most are remembered by a worker, so many of them.
LONG, SHORT_TEXT, MEMO = 100, 160, 200_000

# Attribute tokens of page furniture in the languages of the sites.
MENU = frozenset(
    "home|people|search|shop|archive|archives|about us|about|sign in|log in|visit|events|blog|contact|contact us|machines|donate|news|help|"
    "startseite|personen|suche|kontakt|spenden|impressum|anmelden|archiv|besuch|laden|veranstaltungen|über uns|maschinen|"
    "contacto|buscar|tienda|entrar|personas|inicio|archivo|visitas|eventos|máquinas|donar|"
    "recherche|accueil|boutique|connexion|visite|personnes|événements|dons|"
    "магазин|архив|главная|люди|войти|контакты|поиск|события|машины|首页|人物|档案|捐赠|登录|联系我们|搜索|机器|商店|关于我们".split("|")
)
TOKENS = {
    "notice": r"(?:use|some|des|einige|verwenden|usamos|algunas|файлы)\s+(?:\w+\s+)?cookies?\b|cookies? (?:help|are|stammen|helfen|son|sont|ayudan|nous)|使用cookie|privacy policy|datenschutzerklärung|notre politique|nuestra política|隐私政策|нашу политику|change this in your settings|jederzeit ändern|modifier vos choix|cambiarlo cuando|随时更改设置|настройки можно изменить",
    "bar": r"^(?:share(?: this page)?|print|e-?mail|save|seite teilen|drucken|senden|teilen|merken|speichern|partager(?: cette page)?|imprimer|envoyer|enregistrer|compartir(?: esta página)?|imprimir|guardar|enviar|分享本页|分享|打印|收藏|发送|поделиться|печать|отправить|сохранить)(?:\s*[|·/]\s*|\s{2,}|$)",
    "stamp": r"^(?:last updated|updated|zuletzt geändert|aktualisiert|mis à jour|actualizado|última actualización|最后更新|обновлено)\b",
    "pager": r"^(?:page \d+ (?:of|sur) \d+|seite \d+ von \d+|página \d+ de \d+|第\s*\d+\s*页|страница \d+ из \d+)",
    "advert": r"^(?:sponsored|advertisement|advertising|story continues below|anzeige|werbung|weiter nach der werbung|publicité|la suite après cette annonce|publicidad|anuncio|sigue tras el anuncio|广告|广告之后继续|реклама|продолжение после рекламы)[.:]?$",
    "teaser": r"^(?:read also|see also|read more|lesen sie auch|à lire aussi|lire aussi|lea también|延伸推荐|延伸阅读|читайте также)\s*[:：]",
    "related": r"^(?:related pages|related|most read|popular|latest from the archive|on this site|neu im archiv|meistgelesen|verwandte seiten|ähnliche seiten|auf dieser seite|lo más leído|páginas relacionadas|novedades del archivo|pages liées|les plus lus|sur ce site|nouveau dans les archives|相关页面|热门文章|本站最新|похожие страницы|популярное|новое в архиве|на этом сайте)$",
    "letter": r"newsletter|rundbrief|boletín|notre lettre|(?:нашу )?рассылку|订阅我们|^follow us|^folgen sie|^síganos|^suivez|^关注我们|^следите",
    "comment": r"^(?:\d+ (?:comments?|kommentare?|comentarios?|commentaires?|комментари\w*)|\d+\s*条评论|log in to (?:leave|comment)|zum kommentieren|inicie sesión para|connectez-vous pour|登录后发表|войдите, чтобы|report a mistake|fehler (?:auf dieser seite )?melden|signaler une erreur|avisar de un error|报告错误|сообщить об ошибке)",
    "footer": r"©|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|版权所有|все права защищены|^(?:terms of use|accessibility statement|nutzungsbedingungen|datenschutz|impressum|mentions légales|conditions d'utilisation|aviso legal|使用条款|условия(?: использования)?)$|registered charity|gemeinnütziger verein",
    "site": r"is a volunteer archive|ist ein archiv der|est un fonds bénévole|es un archivo de voluntarios|архив добровольцев|志愿者|volunteer archive",
}
#: Every match of a rule that may stand anywhere holds one of these; most elements hold none.
_HINTS = {
    "notice": tuple("cookie|privacy|datenschutz|politique|política|隐私|политик|settings|ändern|choix|cambiarlo|设置|настройки".split("|")),
    "letter": tuple("newsletter|rundbrief|boletín|lettre|рассылк|订阅|follow us|folgen|síganos|suivez|关注|следите".split("|")),
    "footer": tuple("©|rights|rechte|droits|derechos|版权|права|terms|accessib|nutzung|datenschutz|impressum|mentions|conditions|aviso|使用条款|условия|charity|gemeinn".split("|")),
    "site": tuple("volunteer|archiv|bénévole|доброволь|志愿".split("|")),
}
#: Rules bound to the start of an element, as one; the others with words one of which each match holds.
_STARTS = re.compile("|".join(f"(?P<{k}>{v})" for k, v in TOKENS.items() if v.startswith("^(?:") and k != "footer"), re.I)
_RULES = [(k, re.compile(TOKENS[k], re.I).search, h) for k, h in _HINTS.items()]
_CUT = re.compile(r"\s*[|/·>»›•→]\s*|\s{2,}|\t")
_MARK = re.compile(r"[.!?。！？।።؟;…]+[\"'”»」’)\]]*$")
_INNER = re.compile(r"[.!?。！？।።؟][\"'”»」’)\]]*(?:\s|(?=[^\W\da-z]))")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*")
_LIST = re.compile(r"^\s*(?:[-–•*]\s|\d{1,3}[.)]\s)")
_CAPTION = re.compile(r"^(?:fig|abb|图|圖|рис|図|lám|εικ)[.\s]?\s*\d", re.I)
_DIGIT = re.compile(r"\d")
_TOKEN = re.compile(r"[^\W\d_]+|©")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def _norm(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def elements(text: str, wrapped: bool) -> list[tuple[str, list[int], int]]:
    """(text, line numbers, block number) of the leaves of a page."""
    out: list[tuple[str, list[int], int]] = []
    block, open_block = -1, False
    for i, line in enumerate(text.split("\n")):
        line = line.strip()
        if not line:
            open_block = False
            continue
        fresh, open_block = not open_block, True
        block += fresh
        if wrapped and not fresh:
            t, lines, b = out[-1]
            out[-1] = (f"{t} {line}", [*lines, i], b)
        else:
            out.append((line, [i], block))
    return out


CLASSES = list(TOKENS)


_SEPARATORS = ("|", "/", "·", ">", "»", "›", "•", "→", "\t", "  ")


def attributes(text: str, low: str) -> tuple[int, float, float, int]:
    """(class of the fixed words or -1, share of the sentences that carry it, share of menu words, parts); low: in lower case."""
    parts = [low]
    for c in _SEPARATORS:
        if c in low:
            parts = [p for p in _CUT.split(low) if p]
            break
    menu = sum([p in MENU for p in parts]) / len(parts) if parts else 0.0
    best, share, sentences = "", 0.0, None
    for k, rule, hints in _RULES:
        for h in hints:
            if h in low:
                break
        else:
            continue
        if not rule(text):
            continue
        if sentences is None:
            sentences = [x for x in _SENTENCE.split(text) if x]
        own = max(1, sum([bool(rule(x)) for x in sentences])) / max(1, len(sentences))
        if own > share:
            best, share = k, own
    m = _STARTS.match(text)
    if m is not None:
        own = 1 / max(1, len(sentences if sentences is not None else [x for x in _SENTENCE.split(text) if x]))
        if own > share:
            best, share = m.lastgroup, own
    return CLASSES.index(best) if best else -1, share, menu, len(parts)


def tokens(low: str) -> list[str]:
    """Words of a text in lower case as they stand between blanks; of scripts without spaces, pairs of characters."""
    if not _WIDE.search(low):
        return low.split()
    out = []
    for w in _TOKEN.findall(low):
        if len(w) > 2 and _WIDE.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


OWN = ["log_chars", "words", "mark", "inner_marks", "digit_share", "parts", "menu_share", "list_item", "caption", "ellipsis", *[f"words_{k}" for k in CLASSES], "odds_mean", "odds_max", "odds_first"]
PLACE = [
    "side", "place", "from_end", "block_lines", "block_density", "since_related", "long_before", "long_after", "near_menu", "near_odds",
    "odds_before", "odds_after", "words_before", "words_after", "chars_before", "chars_after", "is_title", "wrapped", "since_hot", "run",
]
FEATURES = OWN + PLACE
_AT = {name: i for i, name in enumerate(FEATURES)}
_W0, _W1 = _AT[f"words_{CLASSES[0]}"], _AT[f"words_{CLASSES[-1]}"] + 1


class Odds:
    """How much a token speaks for furniture (above 0) or for main body, by the labelled sample."""

    def __init__(self, texts: list[str], labels: list[int]):
        count: dict[str, list[int]] = {}
        total = [1, 1]
        for t, y in zip(texts, labels):
            if y >= 0:
                total[y] += 1
                for w in set(tokens(t.lower())):
                    count.setdefault(w, [0, 0])[y] += 1
        self.of = {w: float(np.clip(np.log((b + 0.3) / (total[1] + 1)) - np.log((a + 0.3) / (total[0] + 1)), -4, 4)) for w, (a, b) in count.items() if a + b >= 2}

    def measure(self, low: str) -> tuple[float, float, float]:
        """(mean, largest, first) odds of the tokens of a text in lower case."""
        ws = tokens(low)
        if not ws:
            return 0.0, 0.0, 0.0
        get = self.of.get
        known = [v for v in map(get, ws) if v is not None]
        return sum(known) / len(ws), max(known, default=0.0), get(ws[0], 0.0)


def own_features(text: str, odds: Odds) -> tuple[float, ...]:
    """What a leaf shows by itself, in the order of OWN."""
    n = len(text)
    low = text.lower()
    kind, share, menu, parts = attributes(text, low)
    words = [0.0] * len(CLASSES)
    if kind >= 0:
        words[kind] = share
    return (
        float(np.log1p(n)), min(text.count(" ") + 1, 200), _MARK.search(text, max(0, n - 12)) is not None, min(20, len(_INNER.findall(text))), len(_DIGIT.findall(text)) / n, min(parts, 20), menu,
        _LIST.match(text) is not None, _CAPTION.match(text) is not None, text.endswith("…"), *words, *odds.measure(low),
    )


def _last_at(flag: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position, the last one up to it where the flag is set, on the same page; -1 for none."""
    at = np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))
    return np.where(at >= first, at, -1)


class Pages:
    """The trees of several pages: their leaves end to end, with the features of each."""

    def __init__(self, texts: list[str], titles: list[str | None], wrapped: list[bool], own) -> None:
        """own: a function from the text of a leaf to its own features."""
        self.leaves, sizes = [], []
        for t, w in zip(texts, wrapped):
            e = elements(t, w)
            self.leaves.append(e)
            sizes.append(len(e))
        flat = [e for p in self.leaves for e in p]
        self.n = n = len(flat)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.page = np.repeat(np.arange(len(texts)), self.sizes)
        ends = np.cumsum(self.sizes)
        self.first, self.end = np.repeat(ends - self.sizes, self.sizes), np.repeat(ends, self.sizes)
        self.own = np.array([own(t) for t, _, _ in flat], dtype=np.float32).reshape(n, len(OWN))
        x, i = self.own, np.arange(n)
        chars = np.array([len(t) for t, _, _ in flat], dtype=np.int64)
        mark, ellipsis = x[:, _AT["mark"]] > 0, x[:, _AT["ellipsis"]] > 0
        self.worded = (x[:, _W0:_W1] >= 0.5).any(axis=1) | ((x[:, _AT["menu_share"]] > 0) & ((x[:, _AT["menu_share"]] == 1) | (x[:, _AT["parts"]] >= 2)))
        full = np.array([t[-1] in "。！？" for t, _, _ in flat], dtype=bool)
        self.sized = (chars >= LONG) | ((chars >= 40) & mark & ~ellipsis) | ((chars >= 18) & full)
        self.long = ~self.worded & self.sized
        self.title = np.full(n, -1)
        for p, name in enumerate(titles):
            if name and (name := _norm(name)) and sizes[p]:
                a = ends[p] - sizes[p]
                at = self._title(a, ends[p], [t[0] == name[0] and _norm(t) == name for t, _, _ in self.leaves[p]])
                self.title[a : ends[p]] = at
        self.is_title = self.title == i
        self.side = np.where(self.title < 0, 2, np.sign(i - self.title))
        related = x[:, _AT["words_related"]] >= 0.5
        last_related, breaker = _last_at(related, self.first), _last_at((self.long & ~ellipsis) | self.is_title, self.first)
        self.since = np.where((last_related >= 0) & (last_related > breaker), np.minimum(i - last_related, 12), 99)
        self.x = np.hstack([x, self._place(chars, np.array(wrapped, dtype=bool))])
        # the groups of the tree: runs of short siblings of one region, and each long leaf by itself
        last_long = np.where(self.long, i, -1)
        tail = np.maximum.reduceat(last_long, (ends - self.sizes)[self.sizes > 0]) if n else np.zeros(0)
        tail = np.repeat(tail, self.sizes[self.sizes > 0])
        self.region = self.page * 3 + np.where((self.title >= 0) & (i < self.title), 0, np.where((tail >= 0) & (i > tail), 2, 1))
        new = np.ones(n, dtype=bool)
        new[1:] = (self.region[1:] != self.region[:-1]) | self.long[1:] | self.long[:-1]
        self.group_at = np.flatnonzero(new)

    def _title(self, a: int, b: int, same: list[bool]) -> int:
        """The line of the title: the last one before the first long leaf, else the first if no long leaf is before it."""
        at = [a + k for k, s in enumerate(same) if s]
        if not at:
            return -1
        long = np.flatnonzero(self.long[a:b])
        first = a + int(long[0]) if len(long) else b
        before = [k for k in at if k <= first]
        return before[-1] if before else -1

    def _place(self, chars: np.ndarray, wrapped: np.ndarray) -> np.ndarray:
        n, i, x = self.n, np.arange(self.n), self.own
        block = np.array([b for p in self.leaves for _, _, b in p], dtype=np.int64)
        new = np.ones(n, dtype=bool)
        new[1:] = (block[1:] != block[:-1]) | (self.page[1:] != self.page[:-1])
        at = np.flatnonzero(new)
        lines = np.diff(np.append(at, n))
        dense = np.add.reduceat(chars, at) / lines if n else np.zeros(0)
        longs = np.concatenate([[0], np.cumsum(self.long)])
        odds, menu, words = x[:, _AT["odds_mean"]], x[:, _AT["menu_share"]], self.worded.astype(np.float32)

        def shift(v: np.ndarray, k: int, none: float) -> np.ndarray:
            """The value k leaves away on the same page."""
            j = i + k
            inside = (j >= self.first) & (j < self.end)
            return np.where(inside, v[np.clip(j, 0, max(0, n - 1))] if n else v, none)

        near = [1, -1, 2, -2]
        seen = sum(shift(np.ones(n), k, 0) for k in near)
        around = lambda v: sum(shift(v, k, 0) for k in near) / np.maximum(seen, 1)
        hot = _last_at((odds > 1) | self.worded, self.first)
        calm = _last_at(~((odds > 1) | self.worded), self.first)
        place = [
            self.side, (i - self.first) / np.maximum(1, self.end - self.first), np.minimum(50, self.end - 1 - i), np.repeat(np.minimum(30, lines), lines), np.repeat(np.minimum(2000, dense), lines), self.since,
            np.minimum(20, longs[i] - longs[self.first]), np.minimum(20, longs[self.end] - longs[np.minimum(i + 1, n)]), around(menu), around(odds),
            shift(odds, -1, 0), shift(odds, 1, 0), shift(words, -1, 0), shift(words, 1, 0), np.log1p(shift(chars, -1, 0)), np.log1p(shift(chars, 1, 0)), self.is_title, wrapped[self.page] if len(wrapped) else wrapped,
            np.where(hot >= 0, np.minimum(i - hot, 12), 20), np.minimum(i - np.maximum(calm, self.first - 1), 20),
        ]
        return np.stack(place, axis=1).astype(np.float32) if n else np.zeros((0, len(PLACE)), dtype=np.float32)

    def groups(self, logit: np.ndarray) -> np.ndarray:
        """Features of the groups: size, place, and the density of furniture below them."""
        if not self.n:
            return np.zeros((0, 10), dtype=np.float32)
        at = self.group_at
        size = np.diff(np.append(at, self.n))
        total = lambda v: np.add.reduceat(v.astype(np.float64), at)
        odds, chars = self.x[:, _AT["odds_mean"]], np.expm1(self.x[:, 0])
        return np.stack([
            size, total(logit) / size, np.minimum.reduceat(logit, at), np.maximum.reduceat(logit, at), total(logit > 0) / size, self.region[at] % 3,
            total(odds) / size, np.log1p(total(chars)), self.x[at, _AT["place"]], total(self.long),
        ], axis=1).astype(np.float32)

    def decode(self, leaf: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which leaves are furniture: the best labelling of the trees of leaves, groups and regions.

        A discarded node has only discarded nodes below it; a kept one has a kept one below it.
        """
        if not self.n:
            return np.zeros(0, dtype=bool)
        leaf = np.where(self.is_title, -6.0, np.clip(leaf, -6, 6))
        at, group = self.group_at, np.clip(group, -3, 3)
        size = np.diff(np.append(at, self.n))
        drop = group + np.add.reduceat(leaf, at)
        # all leaves of a kept group want to go: the one that wants it least stays
        forced = np.where(np.minimum.reduceat(leaf, at) > 0, 2 * np.minimum.reduceat(leaf, at), 0)
        keep = -group + np.add.reduceat(np.abs(leaf), at) - forced
        gone = drop >= keep
        # a region is kept if one of its groups is; its own score is the density of furniture in it
        region = np.flatnonzero(np.append(True, np.diff(self.region[at]) != 0))
        own = np.add.reduceat(np.where(gone, 1.0, -1.0) * size, region) / np.add.reduceat(size, region)
        drop_all = own + np.add.reduceat(drop, region)
        keep_some = -own + np.add.reduceat(np.maximum(drop, keep), region)
        spans = np.diff(np.append(region, len(at)))
        gone |= np.repeat((drop_all >= keep_some) & (np.minimum.reduceat(gone.astype(int), region) == 0), spans)
        out = leaf > 0
        gone_leaf = np.repeat(gone, size)
        least = np.repeat(np.minimum.reduceat(leaf, at), size)
        return gone_leaf | (out & ~((least > 0) & (leaf == least)))


class Trees:
    """Gradient-boosted trees for a logistic loss, on binned features; each level of a tree asks one question."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.questions: list[tuple[int, float]] = []
        self.nodes: list[tuple[list[int], np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        cuts = []
        for j in range(m):
            v = np.unique(x[:, j])
            cuts.append(((v[1:] + v[:-1]) / 2) if len(v) <= self.bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])))
        width = self.bins + 1
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) + np.arange(m) * width
        valid = np.zeros((m, width), dtype=bool)
        for j, c in enumerate(cuts):
            valid[j, : len(c)] = True
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        score = np.full(n, self.base)
        number: dict[tuple[int, float], int] = {}
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            leaf, asked = np.zeros(n, dtype=np.int64), []
            for level in range(self.depth):
                count = 2**level
                key = (leaf[:, None] * (m * width) + code).ravel()
                sg = np.bincount(key, np.repeat(g, m), count * m * width).reshape(count, m, width).cumsum(2)
                sh = np.bincount(key, np.repeat(h, m), count * m * width).reshape(count, m, width).cumsum(2)
                tg, th = sg[:, :, -1:], sh[:, :, -1:]
                gain = (sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)).sum(0)
                gain[~valid] = 0
                j, k = divmod(int(gain.argmax()), width)
                if gain[j, k] < 1e-6:
                    break
                asked.append(number.setdefault((j, float(cuts[j][k])), len(number)))
                leaf = leaf * 2 + (code[:, j] - j * width > k)
            if not asked:
                break
            value = self.rate * np.bincount(leaf, g, 2 ** len(asked)) / (np.bincount(leaf, h, 2 ** len(asked)) + 1)
            score += value[leaf]
            self.nodes.append((asked, value))
        self.questions = list(number)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        yes = [(x[:, j] > cut).astype(np.int64) for j, cut in self.questions]
        for asked, value in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for q in asked:
                at = at * 2 + yes[q]
            out += value[at]
        return out


class Model:
    """Odds of tokens and the trees of leaves and groups."""

    def __init__(self, odds: Odds, leaf: Trees, group: Trees):
        self.odds, self.leaf, self.group = odds, leaf, group

    def classify(self, texts: list[str], titles: list[str | None], wrapped: list[bool], memo: dict) -> tuple[Pages, np.ndarray]:
        """The pages and which of their leaves are furniture."""

        def own(text: str) -> tuple[float, ...]:
            if len(text) > SHORT_TEXT:
                return own_features(text, self.odds)
            got = memo.get(text)
            if got is None:
                got = own_features(text, self.odds)
                if len(memo) < MEMO:
                    memo[text] = got
            return got

        pages = Pages(texts, titles, wrapped, own)
        leaf = self.leaf.logit(pages.x)
        return pages, pages.decode(leaf, self.group.logit(pages.groups(leaf)))


# --- labels ---------------------------------------------------------------------------
def _mask(c: Column) -> Column:
    """A leaf with its case and digits masked, without blanks; a long one as it stands."""
    t = F.trim(c)
    return F.when(F.length(t) < 2 * LONG, F.translate(F.lower(t), "123456789 \n\r\t", "000000000")).otherwise(t)


#: What `str.strip` takes off.
_SPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def _leaves(text: Column, wrapped: Column) -> Column:
    return F.filter(F.when(wrapped, F.split(text, r"\n[\s\u00a0\u3000]*\n")).otherwise(F.split(text, "\n")), lambda x: F.btrim(x, F.lit(_SPACE)) != "")


def _long(x: Column) -> Column:
    """As in `Pages`, without the fixed words; a closing mark counts like what it closes."""
    last = F.right(F.rtrim(x), F.lit(1))
    return (F.length(x) >= LONG) | ((F.length(x) >= 40) & last.isin(*".!?。！？।።؟;\"”»’)]")) | ((F.length(x) >= 18) & last.isin(*"。！？"))


def _occurrences(rows: DataFrame) -> DataFrame:
    """doc_id, site and one struct (h, edge) for each leaf, one for the title and one for the page itself (h 0)."""
    # each explode of one value is computed once, not again wherever it is used below
    rows = rows.select("doc_id", "site", "title", F.explode(F.array(_leaves(F.col("clean_text"), F.coalesce(F.col("source_type") == "pdf", F.lit(False))))).alias("e"))
    at = F.filter(F.transform("e", lambda x, i: F.when(_long(x), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", F.explode(F.array(at)))
    rows = rows.withColumn("b", F.explode(F.array(F.struct(F.coalesce(F.get("at", F.lit(0)), F.size("e")).alias("lo"), F.coalesce(F.get("at", F.size("at") - 1), F.lit(-1)).alias("hi")))))
    leaf = F.transform("e", lambda x, i: F.struct(F.xxhash64(_mask(x)).alias("h"), ((i < F.col("b.lo")) | (i > F.col("b.hi"))).cast("int").alias("edge")))
    title = F.struct(F.xxhash64(F.lit("title"), _mask(F.coalesce("title", F.lit("")))).alias("h"), F.lit(0).alias("edge"))
    page = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("edge"))
    return rows.select("doc_id", "site", F.explode(F.concat(leaf, F.array(title, page))).alias("o")).select("doc_id", "site", "o.h", "o.edge")


def evidence(records: DataFrame, sample: DataFrame) -> dict[tuple[str, int], tuple[int, float]]:
    """(site, leaf) of the sample -> (pages of the site that hold it, share of them where it stands at the edge).

    Counted over all documents; only what the sample holds is counted, so the result is as
    bounded as the sample, and so is the broadcast list of what to count.
    """
    asked = sample.select("site", F.explode("hashes").alias("h")).distinct()
    n = asked.count()
    if not n:
        return {}
    counted = _occurrences(records).join(F.broadcast(asked), ["site", "h"]).groupBy("site", "h").agg(F.approx_count_distinct("doc_id", 0.03).alias("n"), F.avg("edge").alias("edge"))
    return {(r.site, r.h): (r.n, r.edge) for r in counted.collect()}


def label(pages: Pages, hashes: list[list[int] | None], links: list[list[int] | None], titles: list[int], sites: list[str | None], seen: dict) -> list[int]:
    """Of each leaf 1 for furniture, 0 for main body, -1 for no opinion."""
    out: list[int] = []
    at = 0
    for p, size in enumerate(pages.sizes):
        known = hashes[p] is not None and len(hashes[p]) == size and sites[p] is not None
        pages_of_site = seen.get((sites[p], 0), (0, 0.0))[0] if known else 0
        own: list[int] = []
        for k in range(size):
            i = at + k
            text = pages.leaves[p][k][0]
            n, edge = seen.get((sites[p], hashes[p][k]), (0, 0.0)) if known else (0, 0.0)
            linked = known and links[p][k] != titles[p] and (sites[p], links[p][k]) in seen
            recurs = n >= max(RECURS, SHARE * pages_of_site)
            if pages.is_title[i]:
                y = 0
            elif pages.side[i] < 0:
                y = 1
            elif linked:
                y = 1
            elif recurs and (n >= COMMON * pages_of_site if pages.sized[i] else edge >= EDGE or n >= MOST * pages_of_site):
                y = 1
            elif recurs and edge < INNER:
                y = 1 if pages.worded[i] else 0
            elif pages.worded[i]:
                y = 1
            elif text.endswith("…") or pages.since[i] <= 6:
                y = 1 if own and own[-1] == 1 and len(text) < 2 * LONG and not pages.long[i] else -1
            elif recurs:
                y = -1
            else:
                y = 0
            own.append(y)
        out += own
        at += size
    return out


def fit(records: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model | None:
    """The model fitted on the leaves of at most `sample` documents; None if there are none."""
    site = F.col("source_id") if "source_id" in records.columns else F.lit(None).cast("string")
    records = records.filter(F.col("clean_text").isNotNull()).select("doc_id", "title", "source_type", "clean_text", site.alias("site"))
    picked = records.filter(F.length("clean_text") <= longest).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = picked.collect()
    if not rows:
        return None
    spark = records.sparkSession
    some = spark.createDataFrame(rows, records.schema)
    leaves = _leaves(F.col("clean_text"), F.coalesce(F.col("source_type") == "pdf", F.lit(False)))
    some = some.select(
        "doc_id", "title", "source_type", "clean_text", "site", F.transform(leaves, lambda x: F.xxhash64(_mask(x))).alias("own"), F.xxhash64(F.lit("title"), _mask(F.coalesce("title", F.lit("")))).alias("name"),
        F.transform(leaves, lambda x: F.xxhash64(F.lit("title"), _mask(F.regexp_replace(x, r"^[^:：]{1,30}[:：]", "")))).alias("links"),
    )
    rows = some.collect()
    seen = evidence(records, some.filter(F.col("site").isNotNull()).select("site", F.concat("own", "links", F.array(F.lit(0).cast("bigint"))).alias("hashes")))
    wrapped = [r.source_type == "pdf" for r in rows]
    texts, titles = [r.clean_text for r in rows], [r.title for r in rows]
    blank = Odds([], [])
    pages = Pages(texts, titles, wrapped, lambda t: own_features(t, blank))
    if not pages.n:
        return None
    y = label(pages, [r.own for r in rows], [r.links for r in rows], [r.name for r in rows], [r.site for r in rows], seen)
    flat = [e[0] for p in pages.leaves for e in p]
    # each half of the documents is scored with the odds of the other one, as unseen pages are
    half = np.array([zlib.crc32(str(r.doc_id).encode()) & 1 for r in rows])[pages.page]
    odds = [Odds([t for t, h in zip(flat, half) if h != k], [v for v, h in zip(y, half) if h != k]) for k in (0, 1)]
    both = iter(half.tolist())
    pages = Pages(texts, titles, wrapped, lambda t: own_features(t, odds[next(both)]))
    labels = np.array(y)
    use = labels >= 0
    leaf = Trees().fit(pages.x[use], labels[use].astype(float))
    logit = leaf.logit(pages.x)
    # a group is furniture if all of it is known to be, main body if a part of it is
    main = np.maximum.reduceat((labels == 0).astype(int), pages.group_at)
    some = np.maximum.reduceat((labels == 1).astype(int), pages.group_at)
    use = (main + some) > 0
    group = Trees(trees=TREES // 2, depth=3).fit(pages.groups(logit)[use], 1.0 - main[use])
    return Model(Odds(flat, y), leaf, group)


def furniture_lines(text: str, title: str | None, wrapped: bool, model: Model) -> list[int]:
    """Numbers of the lines that aren't main body."""
    pages, gone = model.classify([text], [title], [wrapped], {})
    return [i for (_, lines, _), f in zip(pages.leaves[0], gone) if f for i in lines]


def _classified(rows: pd.DataFrame, model: Model, memo: dict) -> list[tuple[list, np.ndarray]]:
    """(leaves, furniture) of each page of a batch."""
    titles = [t if isinstance(t, str) else None for t in rows.title]
    pages, gone = model.classify(rows.clean_text.tolist(), titles, [s == "pdf" for s in rows.source_type], memo)
    ends = np.cumsum(pages.sizes)
    return [(p, gone[b - s : b]) for p, s, b in zip(pages.leaves, pages.sizes, ends)]


def furniture(records: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, line_no) of every non-blank line that isn't main body; distinct."""
    model = fit(records, sample)
    out = "doc_id string, line_no int"
    if model is None:
        return records.sparkSession.createDataFrame([], out)
    shared = records.sparkSession.sparkContext.broadcast(model)  # trees and the tokens of the sample, whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for rows in batches:
            ids, lines = [], []
            for doc, (leaves, gone) in zip(rows.doc_id, _classified(rows, shared.value, memo)):
                own = [i for (_, at, _), f in zip(leaves, gone) if f for i in at]
                ids += [doc] * len(own)
                lines += own
            yield pd.DataFrame({"doc_id": ids, "line_no": np.array(lines, dtype="int32")})

    texts = records.filter(F.col("clean_text").isNotNull()).select("doc_id", "title", "source_type", "clean_text")
    return spread(texts).mapInPandas(run, out).distinct()


def main_bodies(records: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, main_text) of every document; a null text stays null."""
    model = fit(records, sample)
    texts = records.select("doc_id", "title", "source_type", "clean_text")
    if model is None:
        return texts.select("doc_id", F.col("clean_text").alias("main_text")).dropDuplicates(["doc_id"])
    shared = records.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for rows in batches:
            body: list[str | None] = [None] * len(rows)
            some = np.flatnonzero(rows.clean_text.notna().to_numpy())
            for k, (leaves, gone) in zip(some, _classified(rows.iloc[some], shared.value, memo)):
                drop = {i for (_, at, _), f in zip(leaves, gone) if f for i in at}
                body[k] = "\n".join([line for i, line in enumerate(rows.clean_text.iloc[k].split("\n")) if i not in drop]).strip("\n")
            yield pd.DataFrame({"doc_id": rows.doc_id, "main_text": pd.Series(body, index=rows.index, dtype=object)})

    return spread(texts).mapInPandas(run, "doc_id string, main_text string").dropDuplicates(["doc_id"])
