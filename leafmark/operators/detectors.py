"""Field detectors: from what a page shows (spans, rules, boxes, circles) to candidate fields.

A page's evidence is gathered once into a ``Page``; each detector then reads it and leaves
what an earlier one has claimed. All look at a page as a whole, so a page is one call; pages
are streamed through Arrow batches. ``DETECTORS`` lists them by name, and a caller may pass
a list of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import groupby
from operator import itemgetter
from statistics import median

from pyspark.sql import DataFrame

from leafmark.operators.grouped import by_group
from leafmark.sources import pdf

#: Sizes in points (fixed values).
RULE_LENGTH, RULE_THICKNESS, FIELD_HEIGHT, LABEL_REACH = 24.0, 3.0, 12.0, 120.0
MARK_LEAST, MARK_MOST, MARK_SKEW = 5.0, 22.0, 0.35
BLANK_WIDTH, BLANK_HEIGHT, COMB_TOLERANCE, LINES_MULTI = 40.0, 9.0, 2.0, 2.2
FREE_LINES, FREE_WIDTH, FREE_SHARE = 3, 0.40, 0.45
SIGNATURE = re.compile(r"\b(signature|signed|sign here)\b", re.I)
DATE = re.compile(r"\b(date|dated|mm|dd|yyyy)\b", re.I)
PLACEHOLDER = re.compile(r"\b(mm|dd|yyyy)\s*([/.-])\s*(mm|dd|yyyy)", re.I)
LEADERS = re.compile(r"[_.]{4,}")
Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Span:
    text: str
    box: Box
    size: float


@dataclass
class Found:
    detector: str
    kind: str
    box: Box
    sure: float
    label: str | None = None
    group: str | None = None
    cells: int | None = None
    hint: str | None = None


def overlap(a: Box, b: Box, axis: int) -> float:
    """How far two boxes share an axis (0: across, 1: up)."""
    return min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis])


def shared(a: Box, b: Box) -> float:
    """The share of a that b covers."""
    w, h = max(0.0, overlap(a, b, 0)), max(0.0, overlap(a, b, 1))
    return w * h / max(1e-6, (a[2] - a[0]) * (a[3] - a[1]))


def inside(a: Box, b: Box, slack: float = 0.5) -> bool:
    return a[0] >= b[0] - slack and a[1] >= b[1] - slack and a[2] <= b[2] + slack and a[3] <= b[3] + slack


def looks_like_signature(text: str | None) -> bool:
    return bool(text and SIGNATURE.search(text))


def looks_like_date(text: str | None) -> bool:
    return bool(text and DATE.search(text))


def type_from_label(text: str | None) -> str:
    """The type that a label's own words tell; text if none."""
    return "signature" if looks_like_signature(text) else "date" if looks_like_date(text) else "text"


@dataclass
class Page:
    """A page's evidence and what follows from it."""

    spans: list[Span]
    rules: list[Box]
    rects: list[Box]
    circles: list[Box]
    frame: Box
    taken: list[Box] = field(default_factory=list)
    named: set[str] = field(default_factory=set)

    @cached_property
    def body(self) -> float:
        return median(s.size for s in self.spans) if self.spans else 10.0

    @cached_property
    def flat(self) -> list[Box]:
        """Rules across that are long enough and no box's edge."""
        out = [r for r in self.rules if r[2] - r[0] >= RULE_LENGTH and r[3] - r[1] <= RULE_THICKNESS]
        on_edge = lambda r: any(abs(y - r[1]) <= 1.5 and overlap(r, b, 0) >= 0.9 * (r[2] - r[0]) for b in self.rects for y in (b[1], b[3]))
        return [r for r in out if not on_edge(r) and not any(crosses(r, v) for v in self.upright)]

    @cached_property
    def upright(self) -> list[Box]:
        return [r for r in self.rules if r[3] - r[1] >= FIELD_HEIGHT and r[2] - r[0] <= RULE_THICKNESS]

    @cached_property
    def marks(self) -> list[Box]:
        """Small boxes that are nearly square."""
        return [r for r in self.rects if is_mark(r) and not any(r in run for run in self.combs)]

    @cached_property
    def boxes(self) -> list[Box]:
        """Boxes large enough to write in, without those that hold others or frame the page."""
        large = [r for r in self.rects if not is_mark(r) and r[2] - r[0] >= BLANK_HEIGHT and r[3] - r[1] >= BLANK_HEIGHT]
        frames = [r for r in large if shared(self.frame, r) > 0.6 or any(o != r and inside(o, r) for o in self.rects)]
        return [r for r in large if r not in frames and r[2] - r[0] >= BLANK_WIDTH]

    @cached_property
    def combs(self) -> list[list[Box]]:
        """Runs of three or more cells of one size, side by side at one pitch."""
        cells = sorted((r for r in self.rects if r[2] - r[0] <= 30 and r[3] - r[1] <= 30), key=lambda r: (round(r[1]), r[0]))
        out, run = [], []
        for c in [*cells, None]:
            if c and run and abs(c[1] - run[-1][1]) <= 1 and abs(c[0] - run[-1][2]) <= COMB_TOLERANCE and abs((c[2] - c[0]) - (run[0][2] - run[0][0])) <= COMB_TOLERANCE:
                run.append(c)
                continue
            if len(run) >= 2:
                out.append(run)
            run = [c] if c else []
        return out

    @cached_property
    def grid(self) -> list[list[Box]]:
        """Rows of touching boxes that share their columns with the row below: a table, header first."""
        cells = sorted((r for r in self.boxes), key=lambda r: (-round(r[3]), r[0]))
        rows: list[list[Box]] = []
        for c in cells:
            if rows and abs(rows[-1][0][3] - c[3]) <= 1 and abs(rows[-1][-1][2] - c[0]) <= 1:
                rows[-1].append(c)
            else:
                rows.append([c])
        same = lambda a, b: len(a) == len(b) >= 2 and abs(a[0][1] - b[0][3]) <= 1 and all(abs(x[0] - y[0]) <= 1 and abs(x[2] - y[2]) <= 1 for x, y in zip(a, b, strict=True))
        return [r for i, r in enumerate(rows) if (i and same(rows[i - 1], r)) or (i + 1 < len(rows) and same(r, rows[i + 1]))]

    def text_in(self, box: Box) -> list[Span]:
        return [s for s in self.spans if shared(s.box, box) > 0.5]

    def label(self, box: Box, ways: tuple[str, ...] = ("left", "above")) -> str | None:
        """The nearest text to a side, the first way that has one."""
        for way in ways:
            best = None
            for s in self.spans:
                gap = {"left": box[0] - s.box[2], "right": s.box[0] - box[2], "above": s.box[1] - box[3], "below": box[1] - s.box[3]}[way]
                across = way in ("left", "right")
                limit, slack = (LABEL_REACH, 1.5) if across else (40.0 if way == "above" else 24.0, 3.0)
                least = (0.2 if across else 0.15) * min(box[2 + across] - box[across], s.box[2 + across] - s.box[across])
                if -slack <= gap <= limit and overlap(box, s.box, int(across)) >= least and (best is None or (gap, s.box[0], s.text) < best[:3]):
                    best = (gap, s.box[0], s.text)
            if best:
                return clean(best[2])
        return None

    def loose(self) -> list[Span]:
        """Texts that name no field yet."""
        return [s for s in self.spans if clean(s.text) not in self.named]

    def free(self, box: Box) -> bool:
        return not any(shared(box, t) > 0.25 or shared(t, box) > 0.25 for t in self.taken)


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"^[\s*•·.:_|-]+|[\s*•·:_|.-]+$", "", text))


def crosses(a: Box, b: Box) -> bool:
    return overlap(a, b, 0) >= 0 and overlap(a, b, 1) >= 0


def is_mark(r: Box) -> bool:
    w, h = r[2] - r[0], r[3] - r[1]
    return MARK_LEAST <= w <= MARK_MOST and MARK_LEAST <= h <= MARK_MOST and abs(w - h) <= MARK_SKEW * max(w, h)


def rule_box(rule: Box, height: float = FIELD_HEIGHT) -> Box:
    return rule[0], rule[3], rule[2], rule[3] + height


def stretches(page: Page, rule: Box) -> list[Box]:
    """The parts of a rule that no text stands on, long enough to write on."""
    on = sorted(s.box for s in page.spans if abs(s.box[1] - rule[3]) <= 0.6 * s.size and overlap(s.box, rule, 0) > 0)
    out, at = [], rule[0]
    for b in on:
        out.append((at, rule[1], b[0] - 2, rule[3]))
        at = max(at, b[2] + 2)
    out.append((at, rule[1], rule[2], rule[3]))
    return [s for s in out if s[2] - s[0] >= RULE_LENGTH]


def signatures(page: Page) -> Iterator[Found]:
    for box, sure, ways in [*((rule_box(s, 18.0), 0.98, ("below", "left")) for r in page.flat for s in stretches(page, r)), *((b, 0.96, ("left", "above", "below")) for b in page.boxes)]:
        caption = next((c for w in ways if (c := page.label(box, (w,)))), None)
        if looks_like_signature(caption) and not looks_like_date(caption):
            yield Found("signature_line", "signature", box, sure, caption)


def dates(page: Page) -> Iterator[Found]:
    """Three groups of cells with marks between them, or a rule or box beside a printed placeholder."""
    runs = sorted(page.combs, key=lambda r: (-round(r[0][1]), r[0][0]))
    for a, b, c in zip(runs, runs[1:], runs[2:], strict=False):
        marks = [next((s.text.strip() for s in page.spans if s.text.strip() in ("/", "-", ".") and x[-1][2] - 1 <= s.box[0] and s.box[2] <= y[0][0] + 1 and overlap(s.box, x[0], 1) > 0), None) for x, y in ((a, b), (b, c))]
        if marks[0] and marks[0] == marks[1] and abs(a[0][1] - c[0][1]) <= 1:
            box, sizes = (a[0][0], a[0][1], c[-1][2], c[-1][3]), (len(a), len(b), len(c))
            order = {(2, 2, 4): ("MM", "DD", "YYYY"), (4, 2, 2): ("YYYY", "MM", "DD"), (2, 2, 2): ("MM", "DD", "YY")}.get(sizes, tuple("N" * n for n in sizes))
            yield Found("date_box", "date", box, 0.97, page.label(box), cells=sum(sizes), hint=marks[0].join(order))
    for box in [*(rule_box(s) for r in page.flat for s in stretches(page, r)), *page.boxes]:
        near = next((s for s in page.spans if PLACEHOLDER.search(s.text) and (-14 <= box[1] - s.box[3] <= 14 or inside(s.box, box, 2)) and overlap(s.box, box, 0) > 0), None)
        if near:
            yield Found("date_box", "date", box, 0.95, page.label(box), hint=PLACEHOLDER.search(near.text)[0].upper())


def radios(page: Page) -> Iterator[Found]:
    """Rows or columns of circles, each with a text to its right, under a stem to their left or above."""
    left = sorted((c for c in page.circles if is_mark(c)), key=lambda c: (-round(c[1]), c[0]))
    for axis in (1, 0):
        lines: dict[int, list[Box]] = {}
        for c in left:
            lines.setdefault(round(c[axis]), []).append(c)
        for at, run in sorted(lines.items(), reverse=True):
            if len(run) < 2:
                continue
            run.sort(key=lambda c: (c[0], -c[1]))
            whole = (min(c[0] for c in run), min(c[1] for c in run), max(c[2] for c in run), max(c[3] for c in run))
            stem = page.label(whole, ("left", "above"))
            for c in run:
                yield Found("radio_group", "radio", c, 0.96, page.label(c, ("right",)), group=f"{stem or 'group'}@{at}")
            left = [c for c in left if c not in run]


def checkboxes(page: Page) -> Iterator[Found]:
    for m in page.marks:
        option = page.label(m, ("right", "left"))
        yield Found("checkbox", "checkbox", m, 0.96 if option else 0.90, option)


def combs(page: Page) -> Iterator[Found]:
    for run in page.combs:
        box = (run[0][0], run[0][1], run[-1][2], run[-1][3])
        if len(run) >= 3:
            yield Found("comb", "comb", box, 0.97, page.label(box), cells=len(run))


def tables(page: Page) -> Iterator[Found]:
    """Empty cells below a table's header, named by their column."""
    header: list[Box] = []
    for row in page.grid:
        if header and abs(header[0][0] - row[0][0]) <= 1 and len(header) == len(row) and not any(page.text_in(c) for c in row):
            for head, c in zip(header, row, strict=True):
                own = page.text_in(head)
                yield Found("table_cell", "text", c, 0.90, clean(" ".join(s.text for s in own)) if own else None)
        elif any(page.text_in(c) for c in row):
            header = row


def boxes(page: Page) -> Iterator[Found]:
    cells = {c for row in page.grid for c in row}
    for b in page.boxes:
        if b not in cells and not page.text_in(b):
            label = page.label(b)
            many = b[3] - b[1] > LINES_MULTI * 1.2 * page.body
            yield Found("box", "multiline_text" if many else type_from_label(label), b, 0.97, label)


def underlines(page: Page) -> Iterator[Found]:
    for r in page.flat:
        for s in stretches(page, r):
            label = page.label(rule_box(s), ("left", "below"))
            yield Found("underline", type_from_label(label), rule_box(s), 0.99 if label else 0.95, label)


def colon_runs(page: Page) -> Iterator[Found]:
    """Leaders printed as text, and labels with a colon that have room to their right."""
    for s in page.spans:
        for m in LEADERS.finditer(s.text):
            unit = (s.box[2] - s.box[0]) / len(s.text)
            box = (s.box[0] + m.start() * unit, s.box[1], s.box[0] + m.end() * unit, s.box[3])
            yield Found("colon_run", "text", box, 0.70, clean(s.text[: m.start()]) or page.label(box))
    margin = page.frame[2] - min((s.box[0] for s in page.spans), default=page.frame[0]) + page.frame[0]
    for s in page.loose():
        if s.text.rstrip().endswith(":"):
            stop = min((o[0] for o in [*(t.box for t in page.spans), *page.rects, *page.rules, *page.circles] if o[0] >= s.box[2] and overlap(o, s.box, 1) > 0.2 * (s.box[3] - s.box[1])), default=margin)
            box = (s.box[2] + 4, s.box[1], stop - 4, max(s.box[3], s.box[1] + BLANK_HEIGHT))
            if box[2] - box[0] >= BLANK_WIDTH:
                yield Found("colon_run", type_from_label(s.text), box, 0.55, clean(s.text))


def free_text(page: Page) -> Iterator[Found]:
    """Room of three lines or more below a text that ends a block, wide but no large part of the page."""
    line = 1.2 * page.body
    wide = page.frame[2] - page.frame[0]
    for s in page.loose():
        low = max((o[3] for o in [*(t.box for t in page.spans), *page.rects, *page.rules, *page.circles] if o[3] <= s.box[1] + 0.5), default=page.frame[1] + 36)
        box = (s.box[0], low + 2, page.frame[2] - (s.box[0] - page.frame[0]), s.box[1] - 2)
        w, h = box[2] - box[0], box[3] - box[1]
        alone = not any(t is not s and overlap(t.box, s.box, 1) > 0 for t in page.spans)
        if alone and h >= FREE_LINES * line and w >= FREE_WIDTH * wide and w * h <= FREE_SHARE * wide * (page.frame[3] - page.frame[1]):
            yield Found("free_text", "multiline_text", box, 0.60, clean(s.text))


#: The detectors in the order in which they may claim.
DETECTORS: dict[str, Callable[[Page], Iterator[Found]]] = {
    "date_box": dates, "signature_line": signatures, "radio_group": radios, "comb": combs, "table_cell": tables, "checkbox": checkboxes,
    "box": boxes, "underline": underlines, "colon_run": colon_runs, "free_text": free_text,
}
EXACT = {"date_box", "signature_line", "radio_group", "comb", "table_cell", "checkbox", "box", "underline"}


def generate(page: Page, detectors: dict[str, Callable[[Page], Iterator[Found]]] = DETECTORS) -> list[Found]:
    """All candidates of a page in reading order; what one detector found is taken for those after it."""
    out: list[Found] = []
    for find in detectors.values():
        new = [f for f in find(page) if page.free(f.box)]
        page.taken += [f.box for f in new]
        page.named |= {f.label for f in new if f.label}
        out += new
    return sorted(out, key=lambda f: (-f.box[3], f.box[0], f.box[2], f.detector))


def page_of(rows: list[tuple], frame: Box) -> Page:
    """A page of evidence rows (kind, text, x0, y0, x1, y1, size)."""
    box = lambda r: tuple(float(v) for v in r[2:6])
    of = lambda kind: [box(r) for r in rows if r[0] == kind]
    page = Page([Span(r[1] or "", box(r), r[6] or 10.0) for r in rows if r[0] == "span" and (r[1] or "").strip()], of("line"), list(dict.fromkeys(of("rect"))), of("circle"), frame)
    page.taken += of("widget")
    return page


CANDIDATES = "path {0}, page {1}, place bigint, detector string, field_type string, label string, group_id string, cells bigint, hint string, confidence double, x0 double, y0 double, x1 double, y1 double"
FRAME: Box = (0.0, 0.0, 612.0, 792.0)
#: Pages kept as detected, and the most rows of one: the same printed page is detected once in a process.
KEPT, KEPT_ROWS = 128, 200


def _rows_of(found: list[Found]) -> list[tuple]:
    return [(i, f.detector, f.kind, f.label, f.group, f.cells, f.hint, f.sure, *f.box) for i, f in enumerate(found)]


def detect(evidence: DataFrame, frame: Box = FRAME, detectors: dict[str, Callable[[Page], Iterator[Found]]] = DETECTORS) -> DataFrame:
    """Candidates of each page of evidence (path, page, kind, text, x0, y0, x1, y1, size), by reading order."""
    kinds = dict(evidence.dtypes)
    names = ("kind", "text", "x0", "y0", "x1", "y1", "size")

    def page(rows: list[tuple]) -> list[tuple]:
        return [(*rows[0][:2], *r) for r in _rows_of(generate(page_of([r[2:] for r in rows], frame), detectors))]

    rows = evidence.where("page IS NOT NULL").select("path", "page", *names)
    return by_group(rows, ["path", "page"], list(names), page, CANDIDATES.format(kinds["path"], kinds["page"]))


def detect_files(files: DataFrame, frame: Box = FRAME, detectors: dict[str, Callable[[Page], Iterator[Found]]] = DETECTORS) -> DataFrame:
    """``detect`` of the evidence of files (path, content): a file holds its pages whole, so nothing is shuffled.

    A page's rows come in the order in which ``detect`` has them; a file that cannot be read has no candidates.
    """
    order = lambda r: (r[0], (r[1] is not None, (r[1] or "").encode()), *((v is not None, v or 0.0) for v in r[2:]))

    def make() -> Callable[[str, bytes], list[tuple]]:
        whole = lambda rows: _rows_of(generate(page_of(sorted(rows, key=order), frame), detectors))
        before = lru_cache(KEPT)(whole)

        def find(path: str, content: bytes) -> list[tuple]:
            try:
                rows = sorted((r for r in pdf.contents(content) if r[0] is not None), key=itemgetter(0))
            except Exception:  # a bad file must not end the scan
                return []
            pages = ((page, tuple(r[1:] for r in own)) for page, own in groupby(rows, key=itemgetter(0)))
            return [(path, page, *r) for page, own in pages for r in (before if len(own) <= KEPT_ROWS else whole)(own)]

        return find

    return pdf.each_file(files, make, CANDIDATES.format(dict(files.dtypes)["path"], "int"))
