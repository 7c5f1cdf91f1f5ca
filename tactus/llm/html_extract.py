"""Main text of web pages by nearest-URL page differencing.

A page's markup becomes text lines, one a block.  Every page is paired with the page of its host that is nearest in order
of URL path and has other lines; the lines of the two are aligned by longest common subsequence (exact, bit-parallel), and
shared lines are deleted, as menus, notices and share bars repeat from page to page and text does not.  The alignment
runs over all lines of all pages and carries 64-bit hashes of lines, not texts.

Where the alignment can't know, markup that says what it is goes before it:

* never text, so no lines at all: scripts, styles, templates, form controls, nav, footer, aside, dialog; a header outside
  an article; a form, unless it encloses an article or a heading of the first level (a page that is one form);
* not text, though it differs on neighbouring pages: elements whose class, id or role names adverts, menus, sidebars or
  comments (NAMES), and what stands under a heading such as "3 comments" (SURE_COMMENTS), to the end of its element.
  Under a heading such as "Comments" it goes if the heading is shared;
* text, though a neighbour has it too: lines inside an <article>, as neighbours quote the same passages or are copies.
  Only lines in elements whose class names what often repeats (MAYBE: notice, share, search ...) are open to deletion there.

A page without a partner (alone of its host, or all others have the same lines) has nothing to be compared with; there,
and only there, MAYBE and COMMENTS decide by themselves.

Pairing: pages of equal lines in a host have one representative, that of least path and page_id, so a run of copies looks
past itself.  Representatives are in order of host and path; of the ones before and after, that of longer common path
prefix is the partner, the one before on ties.

Defined cases: null or empty html: empty text; null url: host and path empty; repeated rows each get a row; an empty
table gives no rows; extra columns are left out; an unterminated tag or quoted value reaches to the end of the page, as
in browsers.  Parsing is linear in the page.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import written

#: Elements whose content is never text of the page.
DROPPED = frozenset("head script style noscript template nav footer aside button select datalist textarea input iframe object svg math canvas audio video dialog menu".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Elements within a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend summary".split())
#: Words of class, id and role that name what differs from page to page and is no text of it.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs toc pagination pager footer masthead "
    "comment comments disqus respond reply replies newsletter subscribe subscription signup login cookie cookies consent gdpr popup modal complementary contentinfo".split()
)
#: Words of class and id that often name what repeats; differencing decides.
MAYBE = frozenset("notice notices banner share sharing social related recommended overlay topbar toolbar widget search header meta byline tags".split())
#: Headings that announce readers' comments, and those that may.
SURE_COMMENTS = re.compile(r"\d+\s+(?:comments?|responses?|repl(?:y|ies))|(?:reader|user)s?['’]?s? comments|comments\s*\(\d+\)|leave a (?:comment|reply)|join the (?:discussion|conversation)", re.I)
COMMENTS = re.compile(r"comments?|responses|replies|discussion", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?|[\"'])*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-z]+")
#: What is known of a line from its markup: text, open to differencing, open and named by MAYBE, under a heading that may announce comments, not text.
KEEP, OPEN, LIKELY, HEADED, GONE = range(5)
#: Bits of the table of an alignment; a larger one is halved.
TABLE = 1 << 28


def _named(attrs: str) -> set[str]:
    return {w for m in NAMED.finditer(attrs) for w in SPLIT.split((m[2] or m[3] or m[4] or "").lower())}


class _Page:
    """One pass over a page's markup; only blocks, and inline elements that are named, are on the stack."""

    def __init__(self, dropped: frozenset[str], names: frozenset[str], maybe: frozenset[str]):
        self.dropped, self.names, self.maybe = dropped, names, maybe
        self.lines: list[tuple[str, int]] = []
        self.text: list[str] = []
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()
        # depth of the stack at which each region began, 0 for none
        self.skip = self.article = self.gone = self.headed = self.likely = 0
        self.forms: list[list[int]] = []  # depth, lines before, lines are text of a page that is one form
        self.heading = ""

    def end_line(self) -> None:
        if self.text:
            line = SPACE.sub(" ", html_lib.unescape("".join(self.text))).strip()
            self.text.clear()
            if line:
                if self.heading and self.names and not self.gone:
                    # what follows, too, to the end of the element around the heading
                    if SURE_COMMENTS.fullmatch(line):
                        self.gone = max(1, len(self.stack) - 1)
                    elif not self.headed and COMMENTS.fullmatch(line):
                        self.headed = max(1, len(self.stack) - 1)
                self.lines.append((line, GONE if self.gone else HEADED if self.headed else LIKELY if self.likely else KEEP if self.article else OPEN))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack.pop()
            self.open[name] -= 1
            at = len(self.stack)
            if self.text and not self.skip:
                self.end_line()
            self.skip = 0 if at < self.skip else self.skip
            self.article = 0 if at < self.article else self.article
            self.gone = 0 if at < self.gone else self.gone
            self.headed = 0 if at < self.headed else self.headed
            self.likely = 0 if at < self.likely else self.likely
            if self.forms and at < self.forms[-1][0]:
                _, before, whole = self.forms.pop()
                if not whole:
                    self.lines[before:] = [(x, GONE) for x, _ in self.lines[before:]]

    def start(self, name: str, attrs: str) -> None:
        words = _named(attrs) if attrs else set()
        hidden = bool(attrs) and name not in ("html", "body") and HIDDEN.search(attrs) is not None
        root = name in ("html", "body", "article", "main")
        gone = hidden or not root and bool(words & self.names)
        if name in INLINE and not gone:
            return
        if not self.skip:
            self.end_line()
        self.stack.append(name)
        self.open[name] += 1
        depth = len(self.stack)
        if self.skip:
            return
        if name in self.dropped or name == "header" and self.dropped and not self.article and not self.open["main"]:
            self.skip = depth
        elif name == "form" and self.dropped:
            self.forms.append([depth, len(self.lines), 0])
        elif name in ("article", "h1") and self.forms:
            for f in self.forms:
                f[2] = 1
        if gone and not self.gone:
            self.gone = depth
        elif words & self.maybe and not root and not self.likely:
            self.likely = depth
        if name == "article" and not self.article:
            self.article = depth
        self.heading = name if name in HEADINGS else "" if name not in INLINE else self.heading

    def end(self, name: str) -> None:
        if name not in INLINE and not self.skip:
            self.end_line()
        if name in HEADINGS:
            self.heading = ""
        if not self.open[name]:
            return
        if name in INLINE:  # does not close the blocks that were opened within it
            at = len(self.stack) - 1
            while at >= 0 and self.stack[at] in INLINE and self.stack[at] != name:
                at -= 1
            if at < 0 or self.stack[at] != name:
                return
        else:
            at = len(self.stack) - 1
            while self.stack[at] != name:
                at -= 1
        self.pop_to(at)

    def run(self, page: str) -> list[tuple[str, int]]:
        at, n = 0, len(page)
        while at < n:
            m = TAG.search(page, at)
            stop = m.start() if m else n
            if not self.skip and stop > at:
                self.text.append(page[at:stop])
            if not m:
                break
            at = m.end()
            if m[1] is not None and not self.skip:
                self.text.append(html_lib.escape(m[1]))
            if m[3] is None:
                continue
            name, attrs = m[3].lower(), m[4]
            if m[2]:
                self.end(name)
                continue
            if name in VOID or name not in RAW and (attrs == "/" or attrs[-1:] == "/" and attrs[-2] in "\"' \t\n\r\f"):
                if name not in INLINE and not self.skip:
                    self.end_line()
                continue
            if name in CLOSES:
                if not self.skip:
                    self.end_line()
                for depth in range(len(self.stack) - 1, -1, -1):
                    if self.stack[depth] in CLOSES[name]:
                        self.pop_to(depth)
                        break
                    if self.stack[depth] not in INLINE and self.stack[depth] != "p":
                        break
            self.start(name, attrs)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if not self.skip:
                    raw = page[at : end.start() if end else n]
                    self.text.append(raw if name == "title" else html_lib.escape(raw))
                at = end.end() if end else n
                self.end(name)
        self.pop_to(0)
        self.end_line()
        return self.lines


def lines(page: str, dropped: frozenset[str] = DROPPED, names: frozenset[str] = NAMES, maybe: frozenset[str] = MAYBE) -> list[tuple[str, int]]:
    """(line, KEEP, OPEN, LIKELY or GONE) for each block of a page with text, in page order."""
    return _Page(dropped, names, maybe).run(page)


def shared(a: list, b: list) -> set[int]:
    """Positions of a on a longest common subsequence with b.

    What occurs in one of the two only can be on none, so it is left out first.  Rows of the table are integers, a bit an
    element of a; a table of more than TABLE bits is halved at the best split (Hirschberg), so memory is bounded.
    """
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    x, y = [a[i] for i in at], [v for v in b if v in both]
    found: set[int] = set()
    work = [(0, len(x), 0, len(y))]
    while work:
        i0, i1, j0, j1 = work.pop()
        while i0 < i1 and j0 < j1 and x[i0] == y[j0]:
            found.add(at[i0])
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and x[i1 - 1] == y[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.add(at[i1])
        if i0 == i1 or j0 == j1:
            continue
        if (i1 - i0) * (j1 - j0) > TABLE and j1 - j0 > 1:
            mid = (j0 + j1) // 2
            left = _lengths(x[i0:i1], y[j0:mid])
            right = _lengths(x[i0:i1][::-1], y[mid:j1][::-1])
            cut = i0 + int(np.argmax(left + right[::-1]))
            work += [(i0, cut, j0, mid), (cut, i1, mid, j1)]
        else:
            rows = list(_rows(x[i0:i1], y[j0:j1]))
            i, j = i1 - i0, j1 - j0
            while i and j:
                if rows[j - 1] >> (i - 1) & 1:
                    i -= 1  # no longer with this element than without
                elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.add(at[i0 + i])
    return found


def _rows(a: list, b: list) -> Iterator[int]:
    """After each element of b: bit i is 0 where the longest common subsequence with a[: i + 1] is longer than with a[:i]."""
    full, where = (1 << len(a)) - 1, {}
    for i, v in enumerate(a):
        where[v] = where.get(v, 0) | 1 << i
    row = full
    for v in b:
        match = row & where.get(v, 0)
        row = (row + match | row - match) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of each prefix of a, the empty one first, with b."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def extract(pages: DataFrame, dropped: frozenset[str] = DROPPED, names: frozenset[str] = NAMES, maybe: frozenset[str] = MAYBE) -> DataFrame:
    """(page_id, url, text) of every row."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                texts, kinds, hashes, whole = [], [], [], []
                for h in part.column(4):
                    page = lines(h.as_py() or "", dropped, names, maybe)
                    texts.append([x for x, _ in page])
                    kinds.append([k for _, k in page])
                    hashes.append(np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x, _ in page], dtype=np.uint64).view(np.int64))
                    whole.append(xxhash.xxh64_intdigest(hashes[-1].tobytes()) - (1 << 63))
                made = [pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int8())), pa.array(hashes, pa.list_(pa.int64())), pa.array(whole, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *made], names=[*part.schema.names[:4], "lines", "kinds", "hashes", "whole"])

    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|^//", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.regexp_replace(rest, r"^[^/?#]*", "").alias("path"), "html")
    parsed = keyed.mapInArrow(parse, "page_id long, url string, host string, path string, lines array<string>, kinds array<byte>, hashes array<long>, whole long")
    parsed = written(parsed.withColumn("row", F.monotonically_increasing_id()), "page-lines")  # written with its row numbers, so that these stay
    # pages of equal lines in a host are compared once, by their representative
    least = F.min(F.struct("path", F.col("page_id").isNull().alias("no_id"), "page_id", "row"))
    reps = written(parsed.groupBy("host", "whole").agg(least.alias("r")).select("host", "whole", F.col("r.path").alias("path"), F.col("r.page_id").alias("page_id"), F.col("r.row").alias("row")), "page-keys")
    hashed = parsed.select("row", "hashes")
    mine = nearest(reps.select("row", "host", "path", "page_id")).join(hashed, "row").join(hashed.select(F.col("row").alias("other"), F.col("hashes").alias("theirs")), "other", "left")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if y is None else sorted(shared(x, y)) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["row", "shared"])

    aligned = mine.select("row", "hashes", "theirs").mapInArrow(align, "row long, shared array<int>")
    aligned = written(reps.select("row", "host", "whole").join(aligned, "row").select("host", "whole", "shared"), "page-shared")
    # texts move only where markup leaves lines to the alignment; keys are joined first, as many pages may have equal lines
    decided = parsed.withColumn("open", F.exists("kinds", lambda k: (k != KEEP) & (k != GONE)))
    kept = F.transform(F.filter(F.arrays_zip("lines", "kinds"), lambda x: x["kinds"] == KEEP), lambda x: x["lines"])
    shut = decided.where(~F.col("open")).select("page_id", "url", F.array_join(kept, " ").alias("text"))
    marks = decided.where("open").select("row", "host", "whole").join(aligned, ["host", "whole"]).select("row", "shared")
    alone = F.col("shared").isNull()
    headed = alone | F.array_contains("shared", (F.array_position("kinds", F.lit(HEADED).cast("byte")) - 1).cast("int"))
    zipped = F.arrays_zip("lines", "kinds", F.sequence(F.lit(0), F.size("lines") - 1).alias("i"))
    stays = lambda k, i: (k == KEEP) | (k == OPEN) & (alone | ~F.array_contains("shared", i)) | (k == LIKELY) & ~alone & ~F.array_contains("shared", i) | (k == HEADED) & ~headed
    text = F.array_join(F.transform(F.filter(zipped, lambda x: stays(x["kinds"], x["i"])), lambda x: x["lines"]), " ")
    opened = decided.where("open").join(marks, "row").select("page_id", "url", text.alias("text"))
    return shut.unionByName(opened)


def nearest(keys: DataFrame) -> DataFrame:
    """(row, other): the row before or after in order of host and path, of the same host and longer common path; null if it is alone.

    Only keys are sorted, by range, so a large host spreads over many tasks; the first and last key of each task are
    matched across tasks on the driver, two rows a task.
    """
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("host", "path", "page_id", "row")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        before = here = None
        out: list[tuple] = []
        for b in batches:
            for after in zip(*(b.column(c).to_pylist() for c in ("row", "host", "path")), strict=True):
                if here:
                    out.append((task, *here, *_key(before), *_key(after), before is None, False))
                before, here = here, after
                if len(out) >= 10_000:
                    yield _links(out)
                    out = []
        if here:
            out.append((task, *here, *_key(before), *_key(None), before is None, True))
        yield _links(out)

    linked = written(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(link, LINKS), "page-order")
    ends: dict[int, dict] = {}
    for r in linked.where("is_first or is_last").collect():
        task = ends.setdefault(r["task"], {})
        task |= {k: (r["row"], r["host"], r["path"]) for k, v in (("first", r["is_first"]), ("last", r["is_last"])) if v}
    tasks = sorted(ends)
    across = {b: ends[a]["last"] for a, b in zip(tasks, tasks[1:], strict=False)}
    following = {a: ends[b]["first"] for a, b in zip(tasks, tasks[1:], strict=False)}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, near = [], []
            for r in b.to_pylist():
                before = across[r["task"]] if r["is_first"] and r["task"] in across else (r["row_b"], r["host_b"], r["path_b"])
                after = following[r["task"]] if r["is_last"] and r["task"] in following else (r["row_a"], r["host_a"], r["path_a"])
                found = [x for x in (before, after) if x[0] is not None and x[1] == r["host"]]
                rows.append(r["row"])
                near.append(min(found, key=lambda x: -_common(x[2], r["path"]))[0] if found else None)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(near, pa.int64())], names=["row", "other"])

    return linked.mapInArrow(choose, "row long, other long")


LINKS = "task int, row long, host string, path string, row_b long, host_b string, path_b string, row_a long, host_a string, path_a string, is_first boolean, is_last boolean"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _key(row: tuple | None) -> tuple:
    return row or (None, None, None)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in LINKS.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[x for x, _ in fields])


def op4(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
