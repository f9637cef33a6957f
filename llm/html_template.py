"""Main text of web pages by template deduction from equivalence classes of tokens.

Tokens of a page are its tags, told apart by the elements around them, and its blocks of
text. Over the pages of one host each token has an occurrence vector: how often it stands
on each page. Tokens with the same vector form a class. A class is valid if its tokens keep one order
on the pages, and nested if all its occurrences lie in one gap of a larger class; the valid classes,
nested, are the host's template. Everything between template tokens is a slot, and the host's pages
together tell which slots are the article's. Text is extracted from these slots alone; what belongs to
the template or stands in a part around the article goes.

Vectors are never built: a vector is the XOR of a hash of (page, count) over pages, which
Spark aggregates per (host, token) before the shuffle, so a host with a third of all
pages is no hot group. A template holds the tokens on a tenth of a host's pages
or more, so its size is at most ten times the mean tokens of a page, however many pages there are. Pages
with the same content count once. Hosts of few pages share one template.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FEW = 4             # hosts with fewer distinct pages share a template
SHARE = 10          # a class stands on one in so many of the host's pages, or more
SLACK = 100         # one page in so many may break the order or the nesting of a class
STEADY = 10         # text on every page is template text from so many distinct pages on

# Elements by their role.
_RAW = ("script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_MAIN = ("article", "main")
_ASIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "noscript", "template", "svg", "canvas", "object", "audio", "video",
          "button", "select", "map")
_BOXES = ("html", "body", "div", "section", "ul", "ol", "dl", "table", "figure", "blockquote", "fieldset", "details", "center", *_MAIN, *_ASIDE)
_BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "figcaption", "pre",
           "address", "hgroup", "hr", "summary", "legend", "option", "optgroup", *_RAW, *_BOXES)
# Words in class, id and role that name parts around an article.
_NAMES = ("ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
          "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "masthead", "footer", "toolbar",
          "notice", "notices", "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "popup", "modal", "overlay", "share", "sharing",
          "social", "related", "recommended", "widget", "widgets", "search", "login", "signup", "disclaimer", "skip")
_READERS = ("comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "reactions")

_BLOCK_TAGS, _BOX_TAGS, _ASIDE_TAGS, _AROUND, _BY_READERS = map(frozenset, (_BLOCKS, _BOXES, _ASIDE, _NAMES, _READERS))
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*')|=)*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

ASIDE, PLAIN, MAIN = -1, 0, 1


class Box:
    """An element around others: its name, the names down to it, the region it is in, whether readers wrote it."""

    __slots__ = ("name", "path", "region", "readers", "tags")

    def __init__(self, name: str, path: str, region: int, readers: bool):
        self.name, self.path, self.region, self.readers = name, path, region, readers
        self.tags: dict[tuple[str, str], int] = {}

    def token(self, kind: str, value: str) -> int:
        x = xxhash.xxh64_intdigest(f"{self.path}\x00{kind}\x00{value}".encode("utf-8", "surrogatepass"))
        return x - (1 << 64) if x >> 63 else x


class Page:
    """Tokens of a page in order: ``items`` of (token, region, text), text being None for tags."""

    def __init__(self, source: str):
        self.items: list[tuple[int, int, str | None]] = []
        self.boxes: list[Box] = [Box("", "", PLAIN, False)]
        self.parts: list[str] = []
        at, end, find = 0, len(source), _TAG.search
        while at < end:
            found = find(source, at)
            start = found.start() if found else end
            if start > at:
                self.parts.append(source[at:start])
            if not found:
                break
            at = found.end()
            close, name, attributes = found.groups()
            if name:
                name = name.lower()
                if close:
                    self._close(name)
                else:
                    self._open(name, attributes)
                    if name in _RAW:
                        stop = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, at)
                        at = stop.end() if stop else end
        self._flush()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(references.unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                box = self.boxes[-1]
                self.items.append((box.token("text", text), box.region, text))

    def _tag(self, kind: str, label: str) -> None:
        box = self.boxes[-1]
        token = box.tags.get((kind, label))
        if token is None:
            token = box.tags[kind, label] = box.token(kind, label)
        self.items.append((token, box.region, None))

    def _open(self, name: str, attributes: str) -> None:
        if name in _BLOCK_TAGS:
            self._flush()
        elif name == "br":
            self.parts.append(" ")
        named, label = (), name
        if "=" in attributes:
            named = [(k.lower(), a or b or c) for k, a, b, c in _NAMED.findall(attributes)]
            if named:
                label += re.sub(r"\d+", "0", "".join(f" {k}={v}" for k, v in named))
        if name in _BLOCK_TAGS or name in _VOID:
            self._tag("open", label)
        if name in _BOX_TAGS:
            box = self.boxes[-1]
            region, readers = box.region, box.readers
            words = {w.lower() for _, v in named for w in _WORD.findall(v)}
            readers = readers or bool(words & _BY_READERS)
            if name in _MAIN:
                # an article or main part is main text even where an unclosed box stands open before it
                region = ASIDE if readers else MAIN
            elif name in _ASIDE_TAGS and not (name == "header" and region == MAIN):
                region = ASIDE
            elif (readers or words & _AROUND) and name not in ("html", "body"):
                region = ASIDE
            self.boxes.append(Box(name, f"{box.path}/{label}", region, readers))

    def _close(self, name: str) -> None:
        if name in _BLOCK_TAGS:
            self._flush()
            if name in _BOX_TAGS and any(b.name == name for b in self.boxes):
                while self.boxes.pop().name != name:
                    pass
            self._tag("close", name)

    def blocks(self) -> list[tuple[int, int, str]]:
        """Blocks of text in the article, or where the page marks none, in all parts but those around it."""
        found = [x for x in self.items if x[2] is not None]
        main = [x for x in found if x[1] == MAIN]
        return main or [x for x in found if x[1] == PLAIN]


# ---- classes of one page ----------------------------------------------------------------

def out_of_order(places: list[int]) -> set[int]:
    """The numbers that do not fit: a longest ascending part of distinct numbers stays."""
    tails: list[int] = []
    where: list[int] = []
    before: list[int] = []
    for i, x in enumerate(places):
        k = bisect_left(tails, x)
        before.append(where[k - 1] if k else -1)
        if k == len(tails):
            tails.append(x)
            where.append(i)
        else:
            tails[k], where[k] = x, i
    kept, i = set(), where[-1] if where else -1
    while i >= 0:
        kept.add(places[i])
        i = before[i]
    return set(places) - kept


def findings(items: list[tuple], template: dict[int, tuple[int, int]], sizes: dict[int, int]) -> list[tuple[int, int | None, int | None]]:
    """What a page says of the classes on it: (class, token, None) where a token breaks the order,
    (class, None, None) where repeats of the class do not follow each other, (class, None, slot) for the gap it lies in.

    ``template`` gives the class of each token and its place in it; ``sizes`` the tokens of each class.
    """
    seen: dict[int, list[tuple[int, int, int]]] = {}
    for at, (token, _, _) in enumerate(items):
        if token in template:
            cls, place = template[token]
            seen.setdefault(cls, []).append((at, place, token))
    found = []
    for cls, spots in seen.items():
        places = [p for _, p, _ in spots]
        if len(set(places)) == len(places):
            wrong = out_of_order(places)
            found += [(cls, token, None) for _, p, token in spots if p in wrong]
        elif places != list(range(sizes[cls])) * (len(places) // sizes[cls]):
            found.append((cls, None, None))
        # the narrowest gap of another class with more tokens or repeats around all of this one
        first, last, best = spots[0][0], spots[-1][0], None
        for other, around in seen.items():
            if other == cls or (sizes[other], other) < (sizes[cls], cls):
                continue
            ats = [a for a, _, _ in around]
            k = bisect_left(ats, first)
            if k == bisect_left(ats, last):
                width = (ats[k] if k < len(ats) else len(items)) - (ats[k - 1] if k else -1)
                slot = xxhash.xxh64_intdigest(f"{other} {around[k - 1][1] if k else -1}") >> 1
                if best is None or (width, slot) < best:
                    best = (width, slot)
        found.append((cls, None, best[1] if best else 0))
    return found


# ---- the operator -----------------------------------------------------------------------

def host_of(url: str) -> Column:
    """Host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARTS = 256    # templates that a task keeps ready


def _per_page(texts: DataFrame, schema: str, function, columns: list[str], prepare=None) -> DataFrame:
    """Rows of ``columns`` with what ``function`` makes of each page, one at a time, and of its part's template as ``prepare`` gives it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DataType

    full = ", ".join([*(f"{c} {t}" for c, t in texts.select(*columns).dtypes), schema])
    kind = to_arrow_schema(DataType.fromDDL(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict = {}
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                template = None
                if prepare:
                    part = batch["part"][i].as_py()
                    if part not in ready:
                        if len(ready) >= _PARTS:
                            ready.clear()
                        ready[part] = prepare(batch["template"][i].as_py() or [])
                    template = ready[part]
                made.append(function(Page(batch["html"][i].as_py() or ""), template))
            names = kind.names[len(columns):]
            out = [batch[c] for c in columns] + [pa.array([m[j] for m in made], kind.field(n).type) for j, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(out, names=kind.names)

    return texts.mapInArrow(run, full)


def _tokens(page: Page, _) -> tuple:
    first: dict[int, int] = {}
    count = Counter()
    for at, (token, _, _) in enumerate(page.items):
        first.setdefault(token, at)
        count[token] += 1
    content = xxhash.xxh64_intdigest("\n".join(t for _, _, t in page.blocks()).encode("utf-8", "surrogatepass")) >> 1
    text = {token for token, _, t in page.items if t is not None}
    return content, [{"token": t, "n": n, "at": first[t], "text": t in text} for t, n in count.items()]


def templates(pages: DataFrame) -> DataFrame:
    """(part, template) for pages (part, html): valid classes, nested.

    ``template`` lists the tokens with their class, place, whether they are text that stands on all
    of at least ``STEADY`` distinct pages, and the slot of another class in which their class lies.
    """
    seen = _per_page(pages, "content long, tokens array<struct<token: long, n: int, at: int, text: boolean>>", _tokens, ["part"])
    once = stored(seen.groupBy("part", "content").agg(F.first("tokens").alias("tokens")), "page-tokens")
    size = once.groupBy("part").agg(F.count("*").alias("size"))
    tokens = (once.select("part", "content", F.inline("tokens")).groupBy("part", "token")
              .agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("content", "n")).alias("class"), F.avg("at").alias("at"), F.max("n").alias("most"),
                   F.bool_and("text").alias("text"))
              .join(size, "part").where("pages >= 2 AND pages * {0} >= size".format(SHARE)))
    classes = (tokens.groupBy("part", "class").agg(F.sort_array(F.collect_list(F.struct("at", "token", "pages", "most", "text", "size"))).alias("tokens"))
               .where(F.size("tokens") >= 2).select("part", "class", F.posexplode("tokens").alias("place", "t"))
               .select("part", "class", "place", "t.*"))
    classes = stored(classes, "classes")
    drafts = classes.groupBy("part").agg(F.collect_list(F.struct("class", "place", "token")).alias("template"))

    def index(template: list) -> tuple:
        return {t["token"]: (t["class"], t["place"]) for t in template}, Counter(t["class"] for t in template)

    def check(page: Page, draft: tuple) -> tuple:
        return ([dict(zip(("class", "token", "slot"), f, strict=True)) for f in findings(page.items, *draft)],)

    said = _per_page(pages.join(drafts, "part"), "said array<struct<class: long, token: long, slot: long>>", check, ["part"], index)
    said = stored(said.select("part", F.inline("said")).groupBy("part", "class", "token", "slot").agg(F.count("*").alias("n")), "findings")
    on = said.where("slot IS NOT NULL").groupBy("part", "class").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by("slot", F.struct("n", "slot")).alias("slot"))
    broken = said.where("slot IS NULL AND token IS NULL").select("part", "class", F.col("n").alias("broken"))
    nested = (on.join(broken, ["part", "class"], "left").where(f"(all - top) * {SLACK} <= all AND coalesce(broken, 0) * {SLACK} <= all")
              .select("part", "class", "slot", "all"))
    wrong = said.where("token IS NOT NULL").select("part", "class", "token", F.col("n").alias("wrong"))
    valid = (classes.join(nested, ["part", "class"]).join(wrong, ["part", "class", "token"], "left").where(f"coalesce(wrong, 0) * {SLACK} <= all"))
    steady = F.col("text") & (F.col("pages") == F.col("size")) & (F.col("most") == 1) & (F.col("size") >= STEADY)
    return stored(valid.groupBy("part").agg(F.collect_list(F.struct("class", "place", "token", steady.alias("steady"), "slot")).alias("template")), "templates")


_START = 0      # stands before all tokens of every page


def _slotted(page: Page, steady: dict[int, bool]) -> list[tuple[int, int, str]]:
    """(slot, region, text) of the blocks of text that are not the template's; a slot is named by the template token before it."""
    out, slot = [], _START
    for token, region, text in page.items:
        if token in steady and (text is None or steady[token]):
            slot = token
        elif text is not None:
            out.append((slot, region, text))
    return out


def _places(page: Page, steady: dict[int, bool]) -> tuple:
    """Per slot, blocks in the article, blocks beside it, and blocks of a page that marks no article; parts around an article do not count."""
    marked = any(text is not None and region == MAIN for _, region, text in page.items)
    counts: dict[int, list[int]] = {}
    for slot, region, _ in _slotted(page, steady):
        if region != ASIDE:
            counts.setdefault(slot, [0, 0, 0])[0 if region == MAIN else 1 if marked else 2] += 1
    return ([dict(zip(("slot", "inside", "beside", "plain"), (s, *c), strict=True)) for s, c in counts.items()],)


def article_slots(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(part, template) with each token's ``steady`` and ``beside``, from the pages (part, html) and their ``templates``.

    ``beside`` is null where no text of an article follows the token. It is 0 where such text does, and n where up to n blocks
    stand beside the article of the host's pages, ``STEADY`` distinct ones or more, and one page in ``SHARE`` or fewer marks no article.
    """
    keyed = pages.withColumn("page", F.xxhash64("html")).join(found, "part", "left")
    counted = _per_page(keyed, "places array<struct<slot: long, inside: int, beside: int, plain: int>>", _places, ["part", "page"],
                        lambda template: {t["token"]: t["steady"] for t in template})
    once = (counted.select("part", "page", F.inline("places")).groupBy("part", "page", F.col("slot").alias("token"))
            .agg(*[F.max(c).alias(c) for c in ("inside", "beside", "plain")]))
    slots = once.groupBy("part", "token").agg(F.max("inside").alias("inside"), F.max("beside").alias("most"), F.count_if(F.col("beside") > 0).alias("pages"),
                                              F.count_if(F.col("plain") > 0).alias("plain"))
    around = F.col("part") != ""
    around &= (F.col("inside") == 0) & (F.col("pages") >= STEADY) & (F.col("plain") * SHARE <= F.col("pages"))
    slots = slots.select("part", "token", F.when(around, F.col("most")).when((F.col("inside") > 0) | (F.col("plain") > 0), 0).alias("beside"))
    tokens = found.select("part", F.inline("template")).select("part", "token", "steady")
    both = tokens.join(slots, ["part", "token"], "full")
    return stored(both.groupBy("part").agg(F.collect_list(F.struct("token", "steady", "beside")).alias("template")), "slots")


def _known(template: list) -> tuple[dict[int, bool], dict[int, int]]:
    return ({t["token"]: t["steady"] for t in template if t["steady"] is not None}, {t["token"]: t["beside"] for t in template if t["beside"] is not None})


def _slots(page: Page, known: tuple[dict[int, bool], dict[int, int]]) -> tuple:
    """Text of the article's slots, without template text and parts around the article, and the number of slots that hold it."""
    steady, beside = known
    blocks = _slotted(page, steady)
    kept = MAIN if any(text is not None and region == MAIN for _, region, text in page.items) else PLAIN
    count = Counter(slot for slot, region, _ in blocks if region == kept)
    taken = [(slot, text) for slot, region, text in blocks if region == kept and slot in beside and count[slot] > beside[slot]]
    return "\n".join(text for _, text in taken), len({slot for slot, _ in taken})


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text`` (blocks of the article joined by line feeds), ``n_chars``, ``n_slots``.

    Character references are decoded, white space inside a block becomes one space. Menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments are left out, by element or by
    the words of class, id and role; so is template text, that stands once, in place, on every one of
    at least ``STEADY`` distinct pages of a host. A page without ``article`` or ``main`` gives all that stands
    outside such parts, but for slots that hold text beside the article on the other pages of its host.

    Defined results: null or empty html gives an empty text; a null url, or one without a host, is one more host; text
    without markup is one block; unclosed elements end with the element around them, and an article starts anew even
    in an unclosed box; a tag cut off by the end of the page is no text; repeated rows give repeated rows and count once
    for the template, as do pages of equal content; long pages are parsed whole, one at a time; an empty table gives no rows.
    """
    known = pages.select("page_id", "url", host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    hosts = stored(known.groupBy("host").agg(F.approx_count_distinct(F.xxhash64("html")).alias("n")), "hosts")
    # the empty name is shared by hosts of few pages
    parts = known.join(hosts, "host").withColumn("part", F.when(F.col("n") >= FEW, F.col("host")).otherwise("")).drop("host", "n")
    own = parts.select("part", "html")
    found = article_slots(own, templates(own))
    out = _per_page(parts.join(found, "part", "left"), "text string, n_slots int", _slots, ["page_id", "url"], _known)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_slots")
