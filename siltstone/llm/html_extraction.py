"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A wrapper is a sequence of elements and text slots, in which a part may be optional or repeated and an element holds such
a sequence again. The first page of a host is its first wrapper; each further page is aligned with it, level by level:

* where two texts differ, the text becomes a slot;
* where neighbours on a page have the same tag, or a run of tags comes again, they become one repeated group;
* where the next parts differ, the nearer of the two is looked for in the other sequence, and what is skipped is optional.

Merging two wrappers is the same as merging a page into one, so each task folds its pages host by host and what is
shuffled is one wrapper a task and host. They are merged FAN_IN at a time, in rounds, so a host with a third of all pages
is folded where its pages are, and never meets in one task. No part is left out: a task hands on a host's wrapper once it
has more than PARTS parts and begins another, and they meet in the rounds, so the host's wrapper has all its pages' parts.

The wrapper tells where its host's article is: the element that most pages mark as such (article, main, a class or id that
says so), or else the region with most text that varies from page to page, less the texts that all pages share and lists
of links. Every page is then aligned with its wrapper, and the text of its article's slots is the result: whole, in page
order, without what its markup calls a menu, header, footer, sidebar, notice, advert, form or comment.

Nulls: a null html gives the empty text, a null page_id or url is carried; pages without a host are one host. Repeated rows
give repeated results. Ties between article marks go to the stronger mark. Long and malformed pages are read whole. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import common
from siltstone.llm.html_pages import BLOCKS, HEADINGS, LEVELS, Node, read

#: Parts beyond which a task hands on a wrapper; wrappers that a task holds and wrappers that are merged at once, at most.
PARTS, HELD, FAN_IN = 3000, 2000, 64
#: The longest run of tags that is recognised as a repeated group.
RUN = 6
#: Wrappers up to so many bytes in all are broadcast.
BROADCAST_BYTES = 32 << 20
#: Pages that must share a text before it can be a template's.
SHARED = 3


@dataclass(slots=True)
class Part:
    """A part of a wrapper. `n`: pages that have it. A text part (key "#") has the hash of its text (0: a slot), its
    characters in all pages and how many of them are in links."""

    key: str
    n: int = 1
    many: bool = False
    optional: bool = False
    text: int = 0
    chars: int = 0
    links: int = 0
    inside: list[Part] = field(default_factory=list)

    def plain(self) -> list:
        flags = self.many + 2 * self.optional
        return [self.key, self.n, flags, self.text, self.chars, self.links] if self.key == "#" else [self.key, self.n, flags, [p.plain() for p in self.inside]]


def _part(row: list) -> Part:
    if row[0] == "#":
        return Part("#", row[1], bool(row[2] & 1), bool(row[2] & 2), *row[3:])
    return Part(row[0], row[1], bool(row[2] & 1), bool(row[2] & 2), inside=[_part(x) for x in row[3]])


def load(text: str) -> Part:
    return _part(json.loads(text))


def dump(wrapper: Part) -> str:
    return json.dumps(wrapper.plain(), ensure_ascii=False, separators=(",", ":"))


def size(part: Part) -> int:
    return 1 + sum(map(size, part.inside))


def of_page(node: Node) -> Part:
    """A page's own wrapper, with its repeats folded."""
    if node.tag == "#":
        said = node.said()
        return Part("#", text=xxhash.xxh32_intdigest(said) or 1, chars=len(said), links=min(node.links, len(said)))
    return Part(node.key, inside=folded([of_page(x) for x in node.inside if x.tag != "#" or x.said()]))


def folded(parts: list[Part]) -> list[Part]:
    """Neighbours of one key become one repeated part, runs that come again one repeated group."""
    out: list[Part] = []
    for p in parts:
        if out and out[-1].key == p.key and p.key != "#":
            _same_page(out[-1], p)
            out[-1].many = True
        else:
            out.append(p)
    if len(out) < 4:
        return out
    keys, grouped, i = [p.key for p in out], [], 0
    while i < len(out):
        run = next((k for k in range(2, RUN + 1) if keys[i : i + k] == keys[i + k : i + 2 * k] and len(set(keys[i : i + k])) > 1), 0)
        if not run:
            grouped.append(out[i])
            i += 1
            continue
        group = _group(out[i : i + run])
        i += run
        while keys[i : i + run] == keys[i - run : i]:
            _same_page(group, _group(out[i : i + run]))
            i += run
        group.many = True
        grouped.append(group)
    return grouped


def _group(parts: list[Part]) -> Part:
    return Part(f"({' '.join(p.key for p in parts)})", max(p.n for p in parts), inside=parts)


def _same_page(a: Part, b: Part) -> None:
    """Merge another occurrence of a part on the same pages."""
    n = max(a.n, b.n)
    merge(a, b, PARTS, same=True)
    a.n = n


def merge(a: Part, b: Part, room: int, same: bool = False) -> int:
    """Merge b into a; returns the room that is left for new parts, less than 0 if they took more than there was."""
    a.n = max(a.n, b.n) if same else a.n + b.n
    a.many |= b.many
    a.optional |= b.optional
    if a.key == "#":
        a.text = a.text if a.text == b.text else 0
        a.chars += b.chars
        a.links += b.links
        return room
    a.inside, room = _aligned(a.inside, b.inside, room, same)
    return room


def _aligned(mine: list[Part], theirs: list[Part], room: int, same: bool) -> tuple[list[Part], int]:
    out: list[Part] = []
    i = j = 0
    my_places, their_places = _places(mine), _places(theirs)

    def new(p: Part) -> None:
        nonlocal room
        room -= size(p)
        p.optional = True
        out.append(p)

    while i < len(mine) and j < len(theirs):
        a, b = mine[i], theirs[j]
        if a.key == b.key:
            room = merge(a, b, room, same)
            out.append(a)
            i, j = i + 1, j + 1
        elif a.key[0] == "(" and [p.key for p in theirs[j : j + len(a.inside)]] == [p.key for p in a.inside]:
            room = merge(a, _group(theirs[j : j + len(a.inside)]), room, same)
            out.append(a)
            i, j = i + 1, j + len(a.inside)
        elif b.key[0] == "(" and [p.key for p in mine[i : i + len(b.inside)]] == [p.key for p in b.inside]:
            group = _group(mine[i : i + len(b.inside)])
            room = merge(group, b, room, same)
            out.append(group)
            i, j = i + len(b.inside), j + 1
        elif out and out[-1].key == b.key != "#":
            room = merge(out[-1], b, room, same=True)
            out[-1].many = True
            j += 1
        else:
            to_me = _next(their_places, a.key, j)
            to_them = _next(my_places, b.key, i)
            if to_me and (not to_them or to_me - j <= to_them - i):
                for p in theirs[j:to_me]:
                    new(p)
                j = to_me
            elif to_them:
                for p in mine[i:to_them]:
                    p.optional = True
                    out.append(p)
                i = to_them
            else:
                a.optional = True
                out.append(a)
                new(b)
                i, j = i + 1, j + 1
    for p in mine[i:]:
        p.optional = True
        out.append(p)
    for p in theirs[j:]:
        if out and out[-1].key == p.key != "#":
            room = merge(out[-1], p, room, same=True)
            out[-1].many = True
        else:
            new(p)
    return out, room


def _places(parts: list[Part]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for k in range(len(parts) - 1, -1, -1):
        found.setdefault(parts[k].key, []).append(k)  # in falling order: the next place is popped from the end
    return found


def _next(places: dict[str, list[int]], key: str, after: int) -> int:
    """The first place of a key beyond `after`; 0 if there is none."""
    found = places.get(key, [])
    while found and found[-1] <= after:
        found.pop()
    return found[-1] if found else 0


def expression(part: Part) -> str:
    """The wrapper as a regular expression over tags; #: a slot."""
    if part.key == "#":
        body = "#" if not part.text else "text"
    else:
        inside = " ".join(map(expression, part.inside))
        body = f"({inside})" if part.key[0] == "(" else f"<{part.key[1:]}>{f' {inside} ' if inside else ''}</>"
    return f"({body}){'*' if part.optional else '+'}" if part.many else f"({body})?" if part.optional else body


class Wrapper:
    """A host's wrapper, with what it says of its parts."""

    def __init__(self, root: Part) -> None:
        self.root = root
        marks = [0] * (LEVELS + 1)
        self._marks(root, marks)
        #: The mark that most pages have, the stronger one first; 0 if none.
        self.level = max(range(LEVELS, -1, -1), key=lambda k: (marks[k], -k)) if any(marks) else 0
        region = self._region(root)
        self.region = {id(p) for p in _under(region)}
        # Pages of which no single text varies are copies; what they share is no template.
        self.shared = {id(p) for p in _under(root) if p.key == "#" and p.text and p.n >= SHARED and 2 * p.n >= root.n} if _varies(root) else set()
        self.links = {id(p) for p in _under(root) if p.key[1:3] in ("ul", "ol", "di", "ta", "se") and p.many is False and _links(p)}
        self._inside: dict[int, tuple[list[Part], dict[str, list[int]]]] = {}

    def inside(self, part: Part) -> tuple[list[Part], dict[str, list[int]]]:
        """The parts within a part, with groups opened, and the places of each key, made when first asked for."""
        if id(part) not in self._inside:
            flat = [x for p in part.inside for x in (p.inside if p.key[0] == "(" else [p])]
            places: dict[str, list[int]] = {}
            for k, p in enumerate(flat):
                places.setdefault(p.key, []).append(k)
            self._inside[id(part)] = flat, places
        return self._inside[id(part)]

    def _marks(self, part: Part, marks: list[int]) -> None:
        for p in part.inside:
            level = int(p.key[0]) if p.key[0].isdigit() else 0
            if level:
                marks[level] += p.n
            if p.key[0] not in "-=":
                self._marks(p, marks)

    def _varying(self, part: Part) -> int:
        if part.key[0] in "-=~":
            return 0
        return part.chars - part.links if part.key == "#" and not part.text else sum(map(self._varying, part.inside))

    def _region(self, part: Part) -> Part:
        """The smallest element that holds most of the text that varies, as long as no heading or paragraph is left beside it."""
        while True:
            whole = self._varying(part)
            inner = next((p for p in part.inside if whole and self._varying(p) * 5 >= whole * 3), None)
            if inner is None or inner.key == "#" or inner.key[0] == "(" or inner.key[1:].split(".")[0] in ("p", "li", "tr", "td", "pre", "blockquote", *HEADINGS):
                return part
            if any(p is not inner and (p.key == "#" or p.key[1:].split(".")[0] in ("p", *HEADINGS)) and self._varying(p) for p in part.inside):
                return part
            part = inner


def _under(part: Part) -> Iterator[Part]:
    yield part
    for p in part.inside:
        yield from _under(p)


def _varies(part: Part) -> bool:
    """Whether a text differs between pages, and not only between the occurrences of a repeated part."""
    return any(not p.many and (not p.text if p.key == "#" else _varies(p)) for p in part.inside)


def _links(part: Part) -> bool:
    texts = [p for p in _under(part) if p.key == "#"]
    chars = sum(p.chars for p in texts)
    return len(texts) > 0 and chars > 0 and 10 * sum(p.links for p in texts) >= 7 * chars


def followed(wrapper: Wrapper, part: Part | None, nodes: list[Node]) -> Iterator[tuple[Node, Part | None]]:
    """The nodes with the part within `part` that each is an occurrence of, if it has been learnt."""
    flat, places = wrapper.inside(part) if part else ([], {})
    at = 0
    for node in nodes:
        own = places.get("#" if node.tag == "#" else node.key)
        if own:
            at = own[min(bisect_left(own, at), len(own) - 1)]
        yield node, flat[at] if own else None


def _tops(node: Node, level: str) -> bool:
    """Whether a node holds an element of this level that is no other's article."""
    return any(x.role == level or (x.role not in "=" and _tops(x, level)) for x in node.inside)


def main_text(page: Node, wrapper: Wrapper) -> str:
    """The text of the page's article, block by block."""
    levels = [wrapper.level, *(k for k in range(1, LEVELS + 1) if k != wrapper.level)] if wrapper.level else range(1, LEVELS + 1)
    level = next((str(k) for k in levels if k and _tops(page, str(k))), "")
    blocks: list[str] = []
    held: list[str] = []
    if level:
        _marked(page, level, False, blocks, held)
    else:
        _emit_region(page, wrapper, blocks, held)
    return "\n".join(blocks)


def _flush(held: list[str], blocks: list[str]) -> None:
    said = " ".join("".join(held).split())
    if said:
        blocks.append(said)
    held.clear()


def _marked(node: Node, level: str, inside: bool, blocks: list[str], held: list[str]) -> None:
    """Texts within elements of the level. What is no part of an article is left out, unless it holds one."""
    for x in node.inside:
        if x.tag == "#":
            if inside:
                held += x.text
            continue
        if x.role in "-=" and (inside or x.role == "=" or not _tops(x, level)):
            if x.tag in BLOCKS:
                _flush(held, blocks)
            continue
        _flush(held, blocks)
        _marked(x, level, inside or x.role == level, blocks, held)
        _flush(held, blocks)


def _emit_region(page: Node, wrapper: Wrapper, blocks: list[str], held: list[str]) -> None:
    """Without a mark: the region's texts less shared ones and lists of links; all but asides where nothing of that is left."""
    for strict in (True, False):
        _varied(page, wrapper.root, wrapper, strict, not strict or id(wrapper.root) in wrapper.region, blocks, held)
        _flush(held, blocks)
        if blocks:
            return


def _varied(node: Node, part: Part | None, wrapper: Wrapper, strict: bool, inside: bool, blocks: list[str], held: list[str]) -> None:
    for x, p in followed(wrapper, part, node.inside):
        here = inside or (p is not None and id(p) in wrapper.region)
        if x.tag == "#":
            if here and not (strict and p is not None and id(p) in wrapper.shared):
                held += x.text
            continue
        if x.role in "-=~" or (strict and p is not None and id(p) in wrapper.links):
            if x.tag in BLOCKS:
                _flush(held, blocks)
            continue
        _flush(held, blocks)
        _varied(x, p, wrapper, strict, here, blocks, held)
        _flush(held, blocks)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without a port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame) -> DataFrame:
    """host, n_pages, wrapper (JSON): one row a host."""
    common.prepare(pages.sparkSession)
    schema = pa.schema([("host", pa.string()), ("slot", pa.int64()), ("wrapper", pa.string())])
    tasks = pages.rdd.getNumPartitions()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, room, given = TaskContext.get().partitionId(), OrderedDict(), {}, Counter()

        def handed(host: str) -> tuple:
            """A wrapper as a row; those of one host get different slots."""
            slot = part + given[host] * tasks
            given[host] += 1
            return host, slot, dump(held.pop(host))

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                    own = of_page(read(page.as_py()))
                    if host in held:
                        room[host] = merge(held[host], own, room[host])
                        held.move_to_end(host)
                    else:
                        held[host], room[host] = own, PARTS - size(own)
                    if room[host] < 0:
                        yield handed(host)
                    elif len(held) > HELD:
                        yield handed(next(iter(held)))
            while held:
                yield handed(next(iter(held)))

        yield from common.emit(schema, rows(), lambda row: len(row[2]))

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted((slot, text) for b in batches for slot, text in zip(b.column("slot").to_pylist(), b.column("wrapper").to_pylist(), strict=True))
        whole = load(texts[0][1])
        for _, text in texts[1:]:
            merge(whole, load(text), PARTS)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([dump(whole)])], schema=schema)

    found = common.settle(pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(learn, "host string, slot bigint, wrapper string"))
    most = found.agg(F.max("slot")).first()[0] or 0
    while most >= 0:
        groups = found.withColumn("slot", F.floor(F.col("slot") / FAN_IN)).groupBy("host", "slot")
        found = groups.applyInArrow(join, "host string, slot bigint, wrapper string")
        most = most // FAN_IN if most >= FAN_IN else -1
    n = F.get_json_object("wrapper", "$[1]").cast("long")
    return found.select("host", n.alias("n_pages"), "wrapper")


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host, n_pages (of the host); the pages are read once more, in their own partitions
    where the wrappers are small enough to be broadcast."""
    common.prepare(pages.sparkSession)
    keyed = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    weight = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    joined = keyed.join(F.broadcast(wrappers) if weight <= BROADCAST_BYTES else wrappers, "host", "left")
    names = [f"{c} {dict(keyed.dtypes)[c]}" for c in ("page_id", "url")]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[str, Wrapper] = OrderedDict()
        for batch in batches:
            out = []
            for host, wrapper, page in zip(batch.column("host").to_pylist(), batch.column("wrapper"), batch.column("html"), strict=True):
                if host not in known:
                    known[host] = Wrapper(load(wrapper.as_py()))
                    if len(known) > HELD // 4:
                        known.popitem(last=False)
                out.append(main_text(read(page.as_py()), known[host]))
            columns = [batch.column(c) for c in ("page_id", "url", "host", "n_pages")]
            yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), *columns[2:]], names=["page_id", "url", "text", "n_chars", "host", "n_pages"])

    return joined.mapInArrow(texts, ", ".join([*names, "text string, n_chars bigint, host string, n_pages bigint"]))


def op11_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, common.settle(infer(pages))).select("page_id", "url", "text", "n_chars")


#: For pages whose article is one `article` element with blocks h1 and p and named references of these tables alone.
OP11_SQL = r"""
WITH cut AS (
  SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)^.*?<article>', ''), '(?s)</article>.*$', '') AS body FROM pages
), said AS (
  SELECT page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '</?b>', '', 'g'),
    '<br>', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))
    for b in regexp_split_to_array(body, '</?(?:p|h1)>')] AS blocks FROM cut
), whole AS (SELECT page_id, url, coalesce(array_to_string([b for b in blocks if b <> ''], chr(10)), '') AS text FROM said)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM whole
"""
