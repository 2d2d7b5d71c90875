"""Operator 8: main text of web pages by composite text density.

A page becomes a small DOM. For every node: characters per tag, adjusted by the share of characters and tags in links
(composite text density), and the sum of its block children's densities; inline elements belong to the block that holds
them. The node with the largest sum holds the article. The smallest density on the path from body to that node is the
threshold: a link-heavy block below it is a menu, and blocks that stand farther off than beside the node need it.

Blocks beside the path stay if they reach the threshold, wherever they stand; below it, only what stands beside the
node or holds a heading inside the outermost block of the path stays.

Menus, footers, sidebars, scripts and hidden elements are known by their tags and aren't counted, nor is a form that
holds the smaller part of the page's text. Class and role names that speak of adverts, notices, sidebars or comments only
count against a block that holds the smaller part of the page's text (or is a single block, and not nearly all of it) and
isn't a heading; ids, and names beside other words that aren't a layout's ("search algorithms"), only against a block
that density doubts (link-heavy, or below half the threshold). A header stays if it has a heading and stands in the
article; the header of a post or an entry is none of the site's. No name decides about what holds the node.

Linear in the page's length, one page at a time, no shuffle. Broken markup is repaired like browsers do for paragraphs
and list items; unclosed elements end with their parents.

Defined results: null, empty or text-free html gives '' and 0; of equal sums the first node in page order wins; repeated
rows and rows without page_id give a row each; empty tables no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodada.llm.common import texts

_ATTRS = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:({_ATTRS})>|([^>]*+)(?:>|\Z))", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Names of layout blocks: those of reader comments, of headers, and the others.
_COMMENTS = "comments?|disqus|respond|replies"
_HEADERS = "headers?|masthead"
_OTHERS = (
    "ads?|adverts?|advertisement|adsbygoogle|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlays?"
    "|newsletter|subscribe|signup|sidebars?|aside|nav|navbar|navigation|menus?|breadcrumbs?|footers?|shar(?:e|ing)|social|related"
    "|recommend(?:ed|ations)?|widgets?|toolbar|paginat(?:ion|or)|pager|login|search|dialog|complementary|contentinfo|skip-link"
)
_NAMED = re.compile(rf"(?:^|[\s_-])(?:({_COMMENTS})|({_HEADERS})|({_OTHERS}))(?=$|[\s_-])", re.I)
#: Words that say nothing beside those names; any other word makes a name doubtful.
_NEUTRAL = frozenset(
    "box container wrapper wrap block section area inner outer content list item items group row col column left right top bottom main global site page primary secondary link links post posts article articles story form bar panel title text body strip unit slot zone module card inline sticky fixed small large".split()
)
_POST_HEADER = re.compile(r"(?:^|[\s_-])(?:post|entry|article|story|chapter)[_-]?headers?(?=$|[\s_-])", re.I)
#: What a name makes of a block; a node's kind is the largest.
_PLAIN, _BY_ID, _FORM, _HEADER, _ASIDE, _COMMENT = range(6)
#: The share of the page's characters from which on a name doesn't count, for blocks that hold blocks and for others.
_MOST = {_FORM: (0.5, 0.5), _HEADER: (0.5, 0.9), _ASIDE: (0.5, 0.9), _COMMENT: (0.9, 0.9)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW = frozenset("script style noscript template iframe svg textarea title select object math canvas audio video noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE_TAGS = frozenset("nav footer aside button menu dialog fieldset head".split())
_KEEP_TAGS = frozenset("html body article main".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag in the value's set ends an open element of the key.
_ENDS = {"p": _BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody"}), "th": frozenset({"td", "th", "tr", "tbody"}), "option": frozenset({"option"})}
_SCOPE = frozenset("html body article main section div ul ol dl table td th blockquote nav footer header aside form".split())


class Page:
    """Nodes in page order as parallel lists; node 0 is the root."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise, self.kind = ["#root"], [-1], [False], [_PLAIN]
        self.runs: list[tuple[int, int, str]] = []  # (node, block, text): inline text in page order
        self.block_node: list[int] = [0]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, at, block = [0], 0, 0
        tags, parents, noise, kinds, runs = self.tag, self.parent, self.noise, self.kind, self.runs

        def new_block() -> int:
            self.block_node.append(stack[-1])
            return len(self.block_node) - 1

        while True:
            m = _MARKUP.search(source, at)
            text = source[at : m.start()] if m else source[at:]
            if text and not noise[stack[-1]]:
                runs.append((stack[-1], block, text))
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        break
                    if tags[stack[k]] in _SCOPE and name not in _BLOCK:
                        break  # a stray inline end tag doesn't close what encloses it
                if name in _BLOCK:
                    block = new_block()
                continue
            attrs = m[3] or m[4] or ""
            if name in _RAW:
                if not attrs.endswith("/") or name not in ("svg", "math"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                runs.append((stack[-1], block, " ")) if not noise[stack[-1]] else None
                continue
            for k in range(len(stack) - 1, 0, -1):
                if name in _ENDS.get(tags[stack[k]], ()):
                    del stack[k:]
                    break
                if tags[stack[k]] in _SCOPE:
                    break
            up = stack[-1]
            tags.append(name)
            parents.append(up)
            hidden, kind = self._named(name, attrs)
            noise.append(noise[up] or hidden or name in _NOISE_TAGS)
            kinds.append(kind)
            if name in _VOID:
                if name in ("br", "hr", "wbr") and not noise[up]:
                    runs.append((up, block, "" if name == "wbr" else " "))
                if name == "hr":
                    block = new_block()
                continue
            stack.append(len(tags) - 1)
            if name in _BLOCK:
                block = new_block()

    @staticmethod
    def _named(name: str, attrs: str) -> tuple[bool, int]:
        """(hidden, kind) by an element's tag and attributes."""
        kind = _HEADER if name == "header" else _FORM if name == "form" else _PLAIN
        if not attrs or name in _KEEP_TAGS:
            return False, kind
        for key, *values in _ATTR.findall(attrs):
            value, key = "".join(values), key.lower()
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return True, kind
            if key in ("class", "id", "role") and name not in _HEADINGS:
                value = _POST_HEADER.sub(" ", value)
                others = [w for w in re.split(r"[\s_-]+", _NAMED.sub(" ", value).lower()) if w and w not in _NEUTRAL and not w[0].isdigit()]
                for comment, header, _ in _NAMED.findall(value):
                    kind = max(kind, _BY_ID if key == "id" or others else _COMMENT if comment else _HEADER if header else _ASIDE)
        return False, kind

    def _set_aside(self) -> list[bool]:
        """Nodes that names take out of the count: their own text and all below."""
        chars, single = [0] * len(self.tag), [True] * len(self.tag)
        for node, _, text in self.runs:
            chars[node] += len("".join(text.split()))
        for k in range(len(self.tag) - 1, 0, -1):
            chars[self.parent[k]] += chars[k]
            single[self.parent[k]] &= single[k] and self.tag[k] not in _BLOCK
        out = list(self.noise)
        for k in range(1, len(out)):
            kind = self.kind[k]
            out[k] = out[k] or out[self.parent[k]] or (kind in _MOST and chars[k] < _MOST[kind][single[k]] * chars[0])
        return out

    def densities(self, out: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
        """Composite density and sum of the block children's densities of each node, characters, and characters in links."""
        n, e = len(self.tag), math.e
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = in_link[self.parent[k]] or self.tag[k] == "a"
        for node, _, text in self.runs:
            if not out[node]:
                size = len("".join(text.split()))
                chars[node] += size
                if in_link[node]:
                    links[node] += size
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            chars[up] += chars[k]
            links[up] += links[k]
            if not out[k]:
                tags[up] += tags[k] + 1
                link_tags[up] += link_tags[k] + in_link[k]
        share = links[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):
            c = chars[k]
            if c and not out[k]:
                lc, t, lt = max(links[k], 1), max(tags[k], 1), max(link_tags[k], 1)
                base = math.log(c / max(c - links[k], 1) * lc + share * c + e)  # at least ln(1 + e)
                density[k] = c / t * max(math.log(c / lc * t / lt), 0.0) / math.log(base)
                if self.tag[k] in _BLOCK:
                    total[self.parent[k]] += density[k]
        return density, total, chars, links

    def main_text(self) -> str:
        """The article's blocks, joined by an empty line."""
        out, n, up = self._set_aside(), len(self.tag), self.parent
        density, total, chars, links = self.densities(out)
        if not chars[0]:
            return ""
        best = max(range(n), key=lambda k: (total[k], -k))
        path, k = [], best
        while k >= 0:
            path.append(k)
            k = up[k]
        outer, article = ("#root", "html", "body"), [False] * n
        for k in range(1, n):
            article[k] = article[up[k]] or self.tag[k] == "article"
        threshold = min((density[k] for k in path if self.tag[k] not in ("#root", "html")), default=0.0)
        on_path, near = set(path), {best, up[best]}
        titled = [False] * n
        for k in range(n - 1, 0, -1):
            titled[k] = titled[k] or (self.tag[k] in _HEADINGS and not self.noise[k])
            titled[up[k]] = titled[up[k]] or titled[k]
        inside = [False] * n
        for k in range(n):
            if k in on_path:
                inside[k] = True
                continue
            low = density[k] < threshold
            stays = inside[up[k]] and not self.noise[k]
            if stays and self.tag[up[k]] in outer and up[k] != best:  # outside the outermost block of the path
                stays = self.tag[k] in _BLOCK and not low and not out[k] and chars[k] > 0
            if stays and out[k] and not out[up[k]]:  # named: only a header of the article itself stays
                stays = self.kind[k] == _HEADER and titled[k] and (up[k] in near or article[k]) and self.tag[up[k]] not in outer
            if stays and self.tag[k] in _BLOCK and not out[k]:
                doubted = low and 2 * links[k] > chars[k] or (self.kind[k] == _BY_ID and 2 * density[k] < threshold)
                afar = up[k] in on_path and up[k] not in near and low and not titled[k]
                stays = not doubted and not afar
            inside[k] = stays
        parts, last = [], -1
        for node, block, text in self.runs:
            if inside[node]:
                if block != last:
                    parts.append([])
                    last = block
                parts[-1].append(text)
        blocks = (" ".join(html.unescape("".join(b)).split()) for b in parts)
        return "\n\n".join(b for b in blocks if b)


def main_text(source: str | None) -> str:
    """The article text of one page."""
    return Page(source).main_text() if source else ""


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sources in texts(batch, "html", 256):
                found = [main_text(s) for s in sources]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(found, pa.string()), pa.array([len(s) for s in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), "url", F.col(html_col).alias("html")).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
