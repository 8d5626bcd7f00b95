"""HTML extraction: the article of a page, and differencing of pages whose URLs lie next to each other."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from html import unescape
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumensift.llm.common import shuffle_partitions
from lumensift.llm.url_filter import host_of, path_of

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>""", re.S)
#: Elements (fixed values, HTML living standard) whose text starts a block of its own.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that hold no text of the article.
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noframes noscript object script search select style svg template textarea title video".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title iframe noframes noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKS = frozenset("ad ads adsense advert advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted promotion recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_PARTS = re.compile("[a-zA-Z]+")
#: A block with a mark among other words in one of its names is dropped if it has at most so many characters and over half of them in links.
SHORT = 400
#: Elements that an opening tag ends though their closing tag is missing, and what keeps it from looking further out (HTML living standard).
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "optgroup": ("option", "optgroup")} | dict.fromkeys(("tbody", "thead", "tfoot"), ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"))
_TABLE = frozenset("caption table tbody td tfoot th thead tr".split())
_SCOPES = BLOCKS - {"address", "div", "p", "li", "dt", "dd"} | {"button", "object", "select", "template", "caption"}
_ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
_P_SCOPES = frozenset("button caption html object table td template th".split())
_NOT_INLINE = BLOCKS | DROPPED | {"button", "object", "template", "caption"}


def _marks(attributes: str) -> tuple[bool, bool]:
    """Whether a name consists of marks only, and whether one has a mark among other words."""
    whole = part = False
    for value in _NAMES.findall(attributes):
        for name in value.strip("\"'").split():
            words = [p.lower() in MARKS for p in _PARTS.findall(name)]
            whole |= bool(words) and all(words)
            part |= any(words)
    return whole, part


def implied_end(names: list[str], name: str) -> int:
    """How many of the open elements ``names`` stay open at the opening tag ``name``."""
    keep = len(names)
    if name in _ENDS:
        ends, stops = _ENDS[name], {"table", "template"} if name in _TABLE else _SCOPES - set(_ENDS[name])
        for i in range(len(names) - 1, -1, -1):
            if names[i] in ends:
                keep = i
            elif names[i] in stops:
                break
    if name in _ENDS_P:
        for i in range(keep - 1, -1, -1):
            if names[i] == "p":
                return i
            if names[i] in _P_SCOPES:
                break
    return keep


def closed_end(names: list[str], name: str) -> int:
    """How many of the open elements ``names`` stay open at the closing tag ``name``; one that closes nothing is passed over."""
    for i in range(len(names) - 1, -1, -1):
        if names[i] == name:
            return i
        if names[i] in _NOT_INLINE and name not in _NOT_INLINE:
            break  # the closing tag of an inline element doesn't end a block
    return len(names)


#: Where a block lies; a block of links is one that has over half of its characters in links that are no headings.
OUTSIDE, INSIDE, LINKS = 0, 1, 2
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def parse(html: str) -> tuple[list[str], list[str]]:
    """(blocks of the article or main element, blocks outside of them), in page order, without what elements and names mark as dropped."""
    lines, zones = blocks(html)
    return [s for s, z in zip(lines, zones) if z], [s for s, z in zip(lines, zones) if not z]


def blocks(html: str) -> tuple[list[str], list[int]]:
    """All blocks in page order without what elements and names mark as dropped; and of each whether it lies OUTSIDE the article or main
    element, INSIDE, or inside and is one of LINKS."""
    lines: list[str] = []
    zones: list[int] = []
    run: list[str] = []
    in_links = 0  # characters of the block in links
    zone = 0  # depth of article and main elements
    open_: list[str] = []  # names of the open elements
    many: Counter[str] = Counter()  # how many of each name are open; only what is open is looked for
    skip = 0  # the dropped element is the one of this depth, if any
    held: list[tuple[int, bool, int, int, int]] = []  # blocks in doubt: depth, whether inside, blocks before, characters and those in links before
    chars = linked = 0
    at = 0

    def end() -> None:
        nonlocal in_links
        if run:
            line = " ".join("".join(run).split())
            run.clear()
            if line:
                lines.append(line)
                zones.append(OUTSIDE if not zone else LINKS if 2 * in_links > len(line) - line.count(" ") else INSIDE)
        in_links = 0

    def text(s: str) -> None:
        nonlocal chars, linked, in_links
        if s and not skip:
            run.append(unescape(s) if "&" in s else s)
            if zone and many["a"] and not any(many[h] for h in _HEADINGS):
                in_links += len("".join(run[-1].split()))
            if held:
                n = len("".join(s.split()))
                chars += n
                linked += n if "a" in open_[held[0][0]:] else 0

    def leave(keep: int) -> None:
        nonlocal skip, chars, linked
        for n in open_[keep:]:
            many[n] -= 1
        del open_[keep:]
        if keep < skip:
            skip = 0
        while held and keep < held[-1][0]:
            end()
            _, within, n, c, a = held.pop()
            if chars - c <= SHORT and 2 * (linked - a) > chars - c:
                keep_ = [(s, z) for s, z in zip(lines[n:], zones[n:]) if z and not within]  # never an article inside of it
                lines[n:], zones[n:] = [s for s, _ in keep_], [z for _, z in keep_]
                chars, linked = c, a

    pos = 0
    while (m := _TOKEN.search(html, pos)):
        text(html[at:m.start()])
        at = pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if not closing and name in RAW:
            stop = re.compile(f"</{re.escape(name)}", re.I).search(html, at)
            if stop or not skip:
                if not skip and name in BLOCKS:
                    end()
                at = pos = stop.start() if stop else len(html)
                if stop and (close := html.find(">", at)) >= 0:
                    at = pos = close + 1
            continue
        if closing:
            keep = closed_end(open_, name) if many[name] else len(open_)
        elif skip and name in ("article", "main") and not zone:
            keep = skip - 1  # what an element left open would swallow ends at the article
        else:
            keep = implied_end(open_, name) if name in _ENDS_P and many["p"] or name in _ENDS and any(many[n] for n in _ENDS[name]) else len(open_)
        was = skip
        if keep < len(open_):
            leave(keep)
        if skip or closing and was and keep == was - 1:
            if not closing and name not in VOID:
                open_.append(name)
                many[name] += 1
            continue  # inside the dropped element, or its own closing tag
        if name in BLOCKS:
            end()
        elif name in ("br", "wbr"):
            run.append(" " if name == "br" else "")
        if closing:
            if name in ("article", "main"):
                zone = max(0, zone - 1)
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        if name in VOID or attributes.endswith("/") and name in ("svg", "iframe", "object"):
            continue
        open_.append(name)
        many[name] += 1
        if name in ("article", "main"):
            zone += 1
            continue
        whole, part = _marks(attributes) if "=" in attributes and name not in ("html", "body") else (False, False)
        if name in DROPPED or name == "header" and not zone or whole:
            end()
            skip = len(open_)
        elif part and name in BLOCKS:
            held.append((len(open_), zone > 0, len(lines), chars, linked))
    text(html[at:])
    leave(0)
    end()
    return lines, zones


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` lie on a longest common subsequence with ``b`` (bit-parallel: one big-integer step for each line of ``b``)."""
    out = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        out[len(a) - 1 - hi] = True
        hi += 1
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    where: dict[str, int] = {}
    for i, s in enumerate(x):
        where[s] = where.get(s, 0) | 1 << i
    full = (1 << len(x)) - 1
    rows, v = [full], full
    for s in y:
        u = v & where.get(s, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j = len(y), len(x)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            out[lo + j - 1] = True
            i, j = i - 1, j - 1
    return out


def shared_lines(lines: list[str], other: list[str], same_page: float = 0.8) -> list[bool] | None:
    """Which of ``lines`` are shared with ``other``; None if ``other`` is the same article again: nothing is left over, or over
    ``same_page`` of the lines are shared and what is left (a date, a counter) is on average less than half as long as what is shared."""
    shared = common_lines(lines, other)
    left = [s for s, x in zip(lines, shared) if not x]
    n, size = len(left), sum(map(len, left))
    if not n or len(lines) - n > same_page * len(lines) and 2 * size / n < (sum(map(len, lines)) - size) / (len(lines) - n):
        return None
    return shared


def main_text(lines: Sequence[str], zones: Sequence[int], shared: Sequence[bool]) -> str:
    """What differencing leaves: of a page with an article, its blocks but shared ones of links; of another page, the blocks not shared."""
    if any(zones):
        kept = [s for s, z, x in zip(lines, zones, shared) if z and not (z == LINKS and x)]
    else:
        kept = [s for s, x in zip(lines, shared) if not x]
    return "\n\n".join(kept)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            found = [blocks(h or "") for h in part.column(part.schema.get_field_index("html")).to_pylist()]
            names = [n for n in part.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.int8()))], names=[*names, "lines", "zones"])


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of range, host and path; each is judged against the last page of different content in its run, else the next one.

    A run has the page before its opener and the next opener, too. ``context`` rows are those pages of other ranges; they give no output.
    """
    at = None  # range and host
    before: list[str] | None = None  # lines of the page before
    last: list[str] | None = None  # lines of the last page with any
    other: list[str] | None = None  # lines of the last page of different content
    waiting: dict[tuple[tuple[str, ...], tuple[int, ...]], list[dict]] = {}  # pages of the run without such a page, by their lines

    for batch in batches:
        rows, texts = [], []

        def settle(own: list[dict], lines: Sequence[str], zones: Sequence[int], shared: Sequence[bool] | None = None) -> None:
            rows.extend(own), texts.extend([main_text(lines, zones, shared or [False] * len(lines))] * len(own))  # noqa: B023

        for row in batch.to_pylist():
            lines = row["lines"]
            fresh = at != (row["_part"], row["host"])
            if lines and not fresh:
                for was in list(waiting):
                    if (shared := shared_lines(list(was[0]), lines)) is not None:
                        settle(waiting.pop(was), *was, shared)
            if fresh or row["opens"]:
                for was, own in waiting.items():
                    settle(own, *was)
                waiting, other, last = {}, None, before or None
            if fresh:
                at, last = (row["_part"], row["host"]), None
            before = lines
            shared = None
            if lines:
                if last is not None and lines != last and (shared := shared_lines(lines, last)) is not None:
                    other = last
                elif other is not None:
                    shared = shared_lines(lines, other)
                last = lines
            if row["context"]:
                continue
            if not lines or shared is not None:
                settle([row], lines, row["zones"], shared)
            else:
                waiting.setdefault((tuple(lines), tuple(row["zones"])), []).append({"page_id": row["page_id"], "url": row["url"]})
        if rows:
            yield _rows(batch.schema, rows, texts)
    if waiting:
        yield _rows(batch.schema, [r for own in waiting.values() for r in own], [main_text(*was, [False] * len(was[0])) for was, own in waiting.items() for _ in own])


def _rows(schema: pa.Schema, rows: list[dict], texts: list[str]) -> pa.RecordBatch:
    kind = schema.field("page_id").type
    return pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in rows], kind), pa.array([r["url"] for r in rows], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


#: Pages of a range, and ranges at most (their bounds are literals of the plan).
RANGE_PAGES, MOST_RANGES = 4096, 2000


def url_ranges(keys: DataFrame, opens: Column, order: list[str], n: int) -> list[tuple]:
    """Cut points for ``order``, chosen among the rows that open a run (about one in 64, known by a hash of the row): for ``n`` ranges, or
    as many as give RANGE_PAGES each, MOST_RANGES at most.

    The rows looked at are a bounded sample of them; any choice gives the same result, only other task sizes.
    """
    heads = keys.where(opens)
    many = heads.count()
    n = max(n, min(MOST_RANGES, 64 * many // RANGE_PAGES))
    step = max(1, many // (50 * n))
    sample = sorted(tuple("" if x is None else x for x in r) for r in heads.where(F.pmod(F.xxhash64(F.lit(7), *order), F.lit(step)) == 0).select(*order).toLocalIterator())
    return sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: each page's main text, blocks joined by an empty line.

    The blocks of every page, without menus, forms, notices, adverts, comments and the like (by element and by class, id and role names), are
    aligned with those of the last page of different content (in order of path inside the host; else the next one) by a longest common
    subsequence. Copies of the same article (``shared_lines``) and pages without such blocks are passed over. Shared blocks go; of a page with
    an article or main element, which is its text, shared blocks of links go, while other lines are kept even if a neighbour has them too.
    Null and empty html give an empty text; pages of null urls form one host; repeated rows are judged each; extra columns are ignored.

    Pages are dealt by ranges of (host, path, page_id), so a large host spreads over many tasks. Runs of pages start at rows picked by
    a hash of their key and overlap by a page to each side, and pages are compared inside their run, so the result does not depend on how
    ranges are cut. If all pages of a run are the same article, its pages stay whole. One shuffle, of extracted text.
    """
    spark = pages.sparkSession
    d = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    order = ["host", "path", "page_id"]
    opens = F.pmod(F.xxhash64(*order), F.lit(64)) == 0
    n = shuffle_partitions(spark)
    cuts = url_ranges(d.select(*order), opens, order, n)
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = d.withColumn("opens", opens).mapInArrow(_parsed, f"page_id {kind}, url string, host string, path string, opens boolean, lines array<string>, zones array<tinyint>")
    key = F.struct(*[F.coalesce(F.col(c), F.lit("" if c != "page_id" else -1).cast(dict(d.dtypes)[c])).alias(c) for c in order])
    lit = lambda t: F.struct(*[F.lit(v).cast(dict(d.dtypes)[c]).alias(c) for c, v in zip(order, t)])
    part = F.size(F.filter(F.array(*[lit(c) for c in cuts]), lambda c: c <= key)) if cuts else F.lit(0)
    parsed = parsed.withColumn("_part", part)
    # the last page of a range and the first of the next one are shown to both
    shown = F.array(F.col("_part"))
    if cuts:
        ends = dict(d.select(part.alias("_part"), key.alias("_k")).groupBy("_part").agg(F.max("_k")).collect())
        none = F.lit(None).cast(f"struct<{', '.join(f'{c}:{dict(d.dtypes)[c]}' for c in order)}>")
        lasts = F.array(*[lit(tuple(ends[p])) if p in ends else none for p in range(len(cuts) + 1)])
        after = F.when((F.col("_part") < len(cuts)) & (key == lasts[F.col("_part")]), F.col("_part") + 1)
        first = F.when((F.col("_part") > 0) & (key == F.array(*[lit(c) for c in cuts])[F.col("_part") - 1]), F.col("_part") - 1)
        shown = F.array_compact(F.array(F.col("_part"), after, first))
    parsed = parsed.withColumn("_own", F.col("_part")).withColumn("_part", F.explode(shown)).withColumn("context", F.col("_part") != F.col("_own"))
    near = parsed.repartition(max(n, len(cuts) + 1), "_part").sortWithinPartitions("_part", "host", "path", "page_id", "url")
    out = near.select("_part", "page_id", "url", "host", "opens", "context", "lines", "zones").mapInArrow(_differenced, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
