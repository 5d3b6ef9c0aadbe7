"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: tags by their path, and pieces of text that no container already tells to be an
aside. Over all pages of a host, each token's occurrence vector (how often each page has it) is kept as a
sum of hashes, so that vectors are compared without being collected and a host's pages are combined before
the shuffle. Pages of equal tokens are one page there: copies tell nothing of a template. Tokens with equal vectors, found in at least half of the host's pages, form a
class; a class is valid when it has several tokens, among them tags, and nests: the paths of its tags hang
below those of valid classes that are found at least as often. The nested classes are the host's template.
What fills the remaining slots is extracted. Text that is itself part of the template is left out everywhere.
Which slots are the article's is told by the page where HTML itself says so: article and main elements, of
which those that the template has go before others (teasers), and elements for asides. Class names only break
ties: a name that as a whole means an aside ("related-posts") marks one; a name that merely holds such a word
("share-price") marks one only where the template has the element and the page no article.

Defined results: null html is empty and gives an empty text; a null url has the host ""; a null id stays
null; repeated rows are extracted each; broken markup is read as far as it goes (an unclosed tag is text,
an unclosed comment or script runs to the end); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from poolsmith.llm.common import checkpoint, shared_table, table

#: Parts in which a host's pages are dealt out when the host's template comes to them.
SALTS = 64
#: Templates of at most so many bytes in all are sent to every task instead.
SENT = 8 << 20
#: At most so many contents that several pages have are sent to every task; more are joined by a shuffle.
COPIED = 1 << 18
SUPPORT = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
_ASIDE_TAGS = frozenset("nav footer aside form script style noscript iframe template title head select button textarea menu dialog svg object canvas audio video map datalist".split())
_ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert banner popup modal overlay comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations subscribe subscription newsletter signup login search pagination pager skip widget toolbar".split()
)
#: May stand beside them in a name that as a whole means an aside.
_BESIDE = frozenset("area articles bar block body box btn button container content entries entry form header heading icon icons inner item items left link links list main msg outer panel posts primary right row secondary section site text the title top bottom widget widgets wrap wrapper".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'/])hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile("[a-z]+")
_HOST = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def names_of(attributes: str) -> tuple[frozenset[str], bool]:
    """The parts of an element's names, and whether one of the names as a whole means an aside."""
    names = [_PART.findall(n) for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    whole = any(not _ASIDE_NAMES.isdisjoint(n) and all(p in _ASIDE_NAMES or p in _BESIDE for p in n) for n in names)
    return frozenset(p for n in names for p in n), whole


def token(kind: str, path: int, text: str = "") -> int:
    x = xxh64_intdigest(f"{kind}\0{path}\0{text}".encode("utf-8", "surrogatepass"))
    return x - 2**64 if x >= 2**63 else x


#: What stands for the page itself, above all tags.
TOP = token("tag", 0)
ROOT = ("", TOP, 0, 0)
#: What an element is marked as besides a token: surely an aside.
ASIDE = -1


class Page:
    """Tokens and text blocks of one page, in page order."""

    def __init__(self, html: str):
        # a path is a hash of the tags on it, as its length has no bound
        self.tags: Counter[tuple[int, int]] = Counter()  # (path, path above it)
        # (path, main: the outermost article's or main's path or 0, doubtful: path of what may be an aside or 0, text), of what is surely no aside
        self.blocks: list[tuple[int, int, int, str]] = []
        self.stack: list[tuple[str, int, int, int]] = []  # (tag, path, doubtful path or 0 or ASIDE, main path or 0)
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self._read(html)
        self._flush()
        self.has_main = any(m for _, m, _, _ in self.blocks)
        self.marks = {p for _, m, d, _ in self.blocks for p in (m, d) if p}

    def _flush(self) -> None:
        if self.text:
            words = " ".join(unescape("".join(self.text)).split())
            self.text = []
            _, path, aside, main = self.stack[-1] if self.stack else ROOT
            if words and aside != ASIDE:
                self.blocks.append((path, main, aside, words))

    def _pop_to(self, place: int) -> None:
        self._flush()
        self.open.subtract(t for t, *_ in self.stack[place:])
        del self.stack[place:]

    def _find(self, tags: tuple[str, ...], stop: frozenset[str] = frozenset()) -> int:
        if not any(self.open[t] > 0 for t in tags):
            return -1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                return i
            if self.stack[i][0] in stop:
                break
        return -1

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _CLOSE_P and (i := self._find(("p",), frozenset(("article", "main", "td", "div", "section", "li")))) >= 0:
            self._pop_to(i)
        if tag in _CLOSES and (i := self._find(_CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select", "article")))) >= 0:
            self._pop_to(i)
        if tag in ("article", "main") and (i := self._find(("nav",))) >= 0:
            self._pop_to(i)  # a menu that was never closed
        if tag not in _INLINE and tag != "br":
            self._flush()
        _, path, aside, main = self.stack[-1] if self.stack else ROOT
        names, whole = names_of(attributes) if attributes else (frozenset(), False)
        above, before = path, aside
        if tag not in _INLINE:
            path = token("tag", path, ".".join([tag, *sorted(names)]))
        if aside != ASIDE:
            page = tag in ("html", "body", "article", "main")
            if tag in _ASIDE_TAGS or names & {"comment", "comments"} or whole and not page or tag == "header" and not main or attributes and _HIDDEN.search(attributes):
                aside = ASIDE
            elif not aside and not page and tag not in _INLINE and names & _ASIDE_NAMES:
                aside = path
        if tag in _INLINE:
            if aside != before:
                self._flush()
        else:
            self.tags[path, above] += 1
            if not main and (tag in ("article", "main") or "main" in names and tag == "div"):
                main = path
        self.open[tag] += 1
        self.stack.append((tag, path, aside, main))

    def _close(self, tag: str) -> None:
        if (i := self._find((tag,))) >= 0:
            if tag in _INLINE:
                if any(t not in _INLINE for t, *_ in self.stack[i:]):
                    return  # a stray end of an inline tag closes no block
                if self.stack[i][2] != (self.stack[i - 1][2] if i else 0):
                    self._flush()
                self.open.subtract(t for t, *_ in self.stack[i:])
                del self.stack[i:]
            else:
                self._pop_to(i)
        elif tag not in _INLINE:
            self._flush()

    def _read(self, html: str) -> None:
        at, pattern, n = 0, _TAG, len(html)
        while at < n:
            less = html.find("<", at)
            if less < 0:
                self.text.append(html[at:])
                return
            if less > at:
                self.text.append(html[at:less])
            nxt = html[less + 1 : less + 2]
            if html.startswith("<!--", less):
                end = html.find("-->", less + 4)
                at = n if end < 0 else end + 3
            elif nxt in ("!", "?"):
                end = html.find(">", less)
                at = n if end < 0 else end + 1
            elif nxt == "/" or nxt.isalpha():
                m = pattern.match(html, less)
                if not m and pattern is _TAG and (m := _LOOSE.match(html, less)):
                    pattern = _LOOSE  # a quote is never closed: from here on tags end at the first >
                if not m:
                    self.text.append("<")
                    at = less + 1
                    if html.find(">", at) < 0:
                        self.text.append(html[at:])
                        return
                    continue
                at = m.end()
                tag = m[2].lower()
                if m[1]:
                    self._close("p" if tag == "p" else tag)
                elif tag == "br":
                    self.text.append(" ")
                elif tag in ("script", "style"):
                    at = _raw_end(html, tag, at)
                elif tag in _VOID:
                    if tag not in _INLINE:
                        self._flush()
                else:
                    self._open(tag, m[3])
                    if tag in _RAW:
                        close = _raw_end(html, tag, at)
                        self._close(tag)
                        at = close
            else:
                self.text.append("<")
                at = less + 1


_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}


def _raw_end(html: str, tag: str, at: int) -> int:
    m = _RAW_END[tag].search(html, at)
    return m.end() if m else len(html)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, content, tokens (token, parent's token, kind, n), has_main, blocks (token, main, doubtful, text). kind: 0 text, 1 tag, 2 tag that marks blocks. content: a hash of all tokens."""
    tokens_type = pa.list_(pa.struct([("token", pa.int64()), ("parent", pa.int64()), ("kind", pa.int32()), ("n", pa.int32())]))
    blocks_type = pa.list_(pa.struct([("token", pa.int64()), ("main", pa.int64()), ("doubtful", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                read = [Page(h or "") for h in part.column(2).to_pylist()]
                hosts, contents, tokens, blocks = [host_of(u) for u in part.column(1).to_pylist()], [], [], []
                for p in read:
                    found = [{"token": TOP, "parent": 0, "kind": 1, "n": 1}]
                    found += [{"token": path, "parent": above, "kind": 1 + (path in p.marks), "n": n} for (path, above), n in p.tags.items()]
                    texts = Counter((path, text) for path, _, _, text in p.blocks)
                    named = {k: token("text", *k) for k in texts}
                    found += [{"token": named[k], "parent": k[0], "kind": 0, "n": n} for k, n in texts.items()]
                    tokens.append(found)
                    contents.append(token("page", 0, repr(sorted((t["token"], t["n"]) for t in found))))
                    blocks.append([{"token": named[path, text], "main": main, "doubtful": doubtful, "text": text} for path, main, doubtful, text in p.blocks])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(tokens, tokens_type), pa.array([p.has_main for p in read], pa.bool_()), pa.array(blocks, blocks_type)], names=["page_id", "url", "host", "content", "tokens", "has_main", "blocks"])

    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return base.mapInArrow(run, "page_id long, url string, host string, content long, tokens array<struct<token: long, parent: long, kind: int, n: int>>, has_main boolean, blocks array<struct<token: long, main: long, doubtful: long, text: string>>")


def template_of(rows: pd.DataFrame) -> pd.DataFrame:
    """One host's tokens of enough support: which of them are its template. Sorted from the outermost class inwards."""
    classes = rows.groupby(["pages", "vector"])
    valid: dict[int, bool] = {0: True}  # tokens of valid classes
    order = sorted(classes.groups, key=lambda k: (-k[0], k[1]))
    changed = True
    while changed:  # a class is taken when all its tags hang below taken classes or itself
        changed = False
        for key in order:
            group = rows.loc[classes.groups[key]]
            own = set(group["token"])
            if len(own) < 2 or not group["kind"].any() or own <= valid.keys():
                continue
            if all(p in valid or p in own for p in group.loc[group["kind"] > 0, "parent"]):
                valid.update(dict.fromkeys(own, True))
                changed = True
    kept = rows[rows["token"].isin(valid.keys())]
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "template": [np.array(sorted(kept.loc[kept["kind"] == 0, "token"]), np.int64)], "marks": [np.array(sorted(kept.loc[kept["kind"] == 2, "token"]), np.int64)]})


def templates(read: DataFrame, support: float = SUPPORT) -> DataFrame:
    """host, template (tokens of text), marks (its tags that mark blocks): one row per host. read: row (a number of its own), host, content, tokens.

    Of pages of equal content, the first votes. Only tokens found in at least ``support`` of a host's pages reach a host's task, so that their number is
    at most 1 / support times the tokens of a mean page, however many pages there are.
    """
    copied = checkpoint(read.groupBy("host", "content").agg(F.count("*").alias("copies"), F.min("row").alias("first")).where("copies > 1").drop("copies"))
    if copied.count() <= COPIED:
        copied = F.broadcast(copied)
    voting = read.join(copied, ["host", "content"], "left").where("first IS NULL OR first = row")
    spots = voting.select("host", F.col("content").alias("page"), F.explode("tokens").alias("t"))
    counts = spots.groupBy("host", "t.token").agg(F.first("t.parent").alias("parent"), F.max("t.kind").alias("kind"), F.count("*").alias("pages"), F.sum(F.xxhash64("page", "t.n") % 2**40).alias("vector"))
    totals = counts.where(F.col("token") == TOP).select("host", F.col("pages").alias("all_pages"))
    common = counts.join(totals, "host").where((F.col("pages") >= 2) & (F.col("pages") >= support * F.col("all_pages")))
    return common.select("host", "token", "parent", "kind", "pages", "vector").groupBy("host").applyInPandas(template_of, "host string, template array<long>, marks array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row."""
    read = shared_table(read_pages(pages).withColumn("row", F.monotonically_increasing_id()), "pages")
    found = checkpoint(templates(read.select("row", "host", "content", "tokens")))
    weight = found.agg(F.sum(8 * (F.size("template") + F.size("marks")) + F.octet_length("host") + 64)).first()[0] or 0
    rows = read.select("page_id", "url", "host", "has_main", "blocks")
    if weight <= SENT:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:  # a host with very many pages is dealt out: its template goes to each of SALTS parts
        dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")
    there = lambda known, x: F.array_contains(F.coalesce(known, F.expr("cast(array() as array<bigint>)")), x)
    # a page with an article of the template's has its text there, else in any article, else outside of recurring doubtful elements
    joined = joined.withColumn("anchored", F.exists("blocks", lambda b: there(F.col("marks"), b["main"])))
    slot = lambda b: F.when(F.col("anchored"), there(F.col("marks"), b["main"])).when(F.col("has_main"), b["main"] != 0).otherwise((b["doubtful"] == 0) | ~there(F.col("marks"), b["doubtful"]))
    kept = F.filter("blocks", lambda b: slot(b) & ~there(F.col("template"), b["token"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return joined.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
