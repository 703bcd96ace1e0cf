"""Candidates on recognised pages, by structure: values beside labels, under column headers, below headings, and alone.

What a line means depends on the lines around it, so a page is one group; a page is small. The lexical tests are plain
functions of a text; rectangles are (x0, y0, x1, y1).
"""

from __future__ import annotations

import re
import unicodedata
from collections import namedtuple
from functools import lru_cache
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import BANK_GUIDE_WORDS, COLUMN_KINDS, EXPLANATORY_WORDS, FINANCIAL_WORDS, LABEL_KINDS, PAGE, SECTION_HEADINGS, by_page

# Families of rules by rank, rule names of labels and columns, words and patterns that tell values from the rest.
FAMILIES = {"label_value": 4, "table_column": 3, "pattern": 2, "section_block": 1}
LABEL_RULES = ("corporate_name", "corporate_name", "corporate_name", "corporate_name", "address", "address", "representative", "representative", "bank", "bank")
COLUMN_RULES = ("person_name", "shareholder_name", "shareholder_name", "address", "address", "customer", "supplier", "subcontractor", "business_partner")
PERSON_HEADINGS = ("役員構成", "株主一覧")
SUMMARY_WORDS = ("合計", "小計", "その他", "値引", "売上高", "構成比", "単位", "年度")
PROCESS_WORDS = ("製品企画", "製品設計", "仕上げ", "鋼材仕入", "部品仕入", "塗料仕入", "物流", "納品")
CONTEXT_WORDS = (
    "項目", "摘要", "対象会社", "役職", "続柄", "株式数", "議決権", "面積", "時価", "利用区分", "建物", "敷地", "売上高", "構成比", "年度", "比率", "合計",
    "相談", "説明", "制度", "協議会",
)
ACCOUNTING_WORDS = (
    "現金", "預金", "売掛金", "棚卸資産", "有形固定資産", "無形固定資産", "投資", "買掛金", "借入金", "資本金", "利益剰余金", "売上高", "売上原価",
    "営業利益", "経常利益", "当期純利益",
)
MARKERS = ("・", "●", "■", "□", "団", "園", "圖", "と", ">", "|", "/", "\\")
MARKED = re.compile(r"株式会社|有限会社|合同会社|[（(]株[）)]?|[（(]有[）)]?|㈱|㈲|株\)|有\)")
MISREAD = re.compile("[帳幅帥師梯椎常]")
NUMERIC = re.compile(r"^[0-9０-９,.\-ー−－%％①-⑳\s]+$")
PLACE = re.compile("都|道|府|県|市|区|町|村|字|丁目|番|号|-|ー|−|－")
BANK = re.compile("銀行|信用金庫|信金|金融公庫|公庫|信用組合")
BANK_NAME = re.compile("[一-龯ぁ-んァ-ヶA-Za-z]{2,}(?:銀行|信用金庫|信金|信用組合|農業協同組合|金融公庫|公庫)")
PREFECTURE = re.compile("東京都|北海道|京都府|大阪府|[一-龯]{2,3}県")
SENTENCE = re.compile("です|ます|された|している|について|に関する|の場合|ため|こと|もの|こちら|ください")
EXTRA_HEADERS = re.compile("No|種類|区分|面積|評価|金額|比率|年度|年.*月.*期|株式数|議決権", re.IGNORECASE)
LENGTHS = {"氏名": (2, 10), "会社名": (4, 36), "銀行名": (3, 40), "住所": (6, 80)}
MARGINS = {"氏名": (0.85, 0.12), "住所": (0.30, 0.16), "会社名": (0.20, 0.18)}
OUTPUT = "file_id string, page int, rule string, kind string, original string, norm string, confidence string, header string, n_lines int, x0 double, y0 double, x1 double, y1 double"


remembered = lru_cache(maxsize=65_536)  # a text is tested many times on its page, and often on others


@remembered
def norm(text: str) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))


def has(text: str, words) -> bool:
    return any(w in text for w in words)


@remembered
def japanese(text: str) -> int:
    return len(re.findall("[぀-ヿ㐀-鿿豈-﫿]", text))


@remembered
def is_noise(t: str) -> bool:
    return not t or has(t, SUMMARY_WORDS) or bool(NUMERIC.match(t)) or (japanese(t) == 0 and len(re.findall("[A-Za-z0-9]", t)) > 12)


@remembered
def is_label(t: str) -> bool:
    t = t.strip(" :：|/・-ー−－")
    return not t or t in _LABEL_ONLY or (len(t) <= 6 and t in CONTEXT_WORDS)


@remembered
def is_context(t: str) -> bool:
    return sum(w in t for w in CONTEXT_WORDS) >= 2


@remembered
def is_sentence(t: str) -> bool:
    return len(t) >= 18 and bool(SENTENCE.search(t))


@remembered
def is_misread(t: str) -> bool:
    if MARKED.search(t) or MISREAD.search(t):
        return False
    n = japanese(t)
    plain = len(re.findall("[A-Za-z0-9]", t))
    marks = sum(not c.isalnum() and not japanese(c) for c in t)
    return (n < 3 and plain + marks >= n + 2) or (marks >= 4 and n < 5)


@remembered
def is_company(t: str) -> bool:
    if is_noise(t) or is_misread(t):
        return False
    if MARKED.search(t) or (MISREAD.search(t) and 4 <= len(t) <= 24):
        return True
    return 3 <= japanese(t) <= 24 and not is_sentence(t)


@remembered
def is_address(t: str) -> bool:
    return not is_noise(t) and not is_sentence(t) and bool(PLACE.search(t)) and japanese(t) >= 3


@remembered
def is_whole_address(t: str) -> bool:
    return is_address(t) and not has(t, ("設置", "制度", "説明", "協議会", "相談", "活動")) and bool(PREFECTURE.search(t)) and bool(re.search("市|区|町|村|字|丁目|番|号", t))


@remembered
def is_bank(t: str) -> bool:
    other = ("相談", "案内", "活動", "取引", "協会", "あっせん", "苦情", "お受け", "知りたい", "委員会")
    return t not in ("取引銀行", "金融機関", "銀行") and not has(t, other) and bool(BANK_NAME.search(t))


@remembered
def is_person(t: str) -> bool:
    return not is_noise(t) and not has(t, ("会社", "銀行", "所在地", "販売", "仕入", "外注", "面積", "比率")) and 2 <= japanese(t) <= 8


_LABEL_ONLY = {w for w, _ in LABEL_KINDS} | {w for w, _ in COLUMN_KINDS} | set(SECTION_HEADINGS)
_LOOKS = {"会社名": is_company, "住所": is_address, "銀行名": lambda t: bool(BANK.search(t)), "氏名": is_person}
_FORMATS = {"会社名": lambda t: bool(MARKED.search(t) or MISREAD.search(t)), "住所": is_address, "銀行名": lambda t: bool(BANK.search(t)), "氏名": is_person}


def joined(words: list) -> str:
    return norm("".join(w.norm for w in words))


def around(words: list) -> tuple:
    return min(w.x0 for w in words), min(w.y0 for w in words), max(w.x1 for w in words), max(w.y1 for w in words)


def height(r: tuple) -> float:
    return max(r[3] - r[1], 1.0)


def grown(r: tuple, x: float, y: float) -> tuple:
    return r[0] - x, r[1] - y, r[2] + x, r[3] + y


def clipped(r: tuple, page: tuple) -> tuple:
    return tuple(max(page[i % 2], min(v, page[2 + i % 2])) for i, v in enumerate(r))


class Line:
    """Words in reading order with their text and rectangle."""

    def __init__(self, words: list):
        self.words, self.norm, self.rect = words, joined(words), around(words)
        self.x0, self.y0, self.x1, self.y1 = self.rect
        self.cx, self.cy = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2
        self.heading = next((h for h in SECTION_HEADINGS if h in self.norm), "")


def lines_of(words: list) -> list[Line]:
    by: dict = {}
    for w in words:
        by.setdefault((w.block, w.line), []).append(w)
    return sorted((Line(sorted(ws, key=lambda w: w.x0)) for ws in by.values()), key=lambda n: (n.y0, n.x0))


def rows_of(lines: list[Line], closeness: float = 0.55) -> list[Line]:
    """Lines whose centres lie within a share of the height of a row's median, put together from the left."""
    rows: list[list[Line]] = []
    for n in lines:
        tall = height(n.rect)
        near = (r for r in rows if abs(n.cy - median(x.cy for x in r)) <= closeness * max(median(height(x.rect) for x in r), tall))
        row = next(near, None)
        if row is None:
            rows.append([n])
        else:
            row.append(n)
    return [Line(sorted((w for n in r for w in n.words), key=lambda w: w.x0)) for r in rows]


def value_words(words: list, kind: str) -> list:
    """The words of a value without numbers, marks and what follows a summary; none if the rest is no such value."""
    words = [w for w in words if w.norm]
    if kind in ("会社名", "銀行名"):
        words = [w for w in words if not NUMERIC.match(w.norm)]
        lead = next((i for i, w in enumerate(words) if w.norm not in MARKERS), len(words))
        stop = next((i for i, w in enumerate(words) if i >= lead and has(w.norm, SUMMARY_WORDS)), len(words))
        words = words[lead:stop]
    else:
        words = [w for w in words if not has(w.norm, SUMMARY_WORDS) and not (kind == "氏名" and NUMERIC.match(w.norm))]
    t = joined(words)
    return words if t and not is_noise(t) and not is_label(t) and not is_context(t) and _LOOKS[kind](t) else []


def unwanted(t: str, kind: str, flags: dict, placed: bool) -> bool:
    """Values that the page's subject or their own words rule out."""
    marked = bool(MARKED.search(t))
    if kind == "会社名":
        return (flags["financial"] and not placed and not marked) or has(t, ACCOUNTING_WORDS) or (is_sentence(t) and not marked)
    if kind == "住所":
        vague = has(t, ("制度", "協議会", "設置", "説明", "相談")) and not re.search("丁目|番|号|字|[0-9０-９]-", t)
        return (flags["explanatory"] and not placed) or vague
    if kind == "銀行名":
        return (not placed and not is_bank(t)) or (flags["bank_guide"] and has(t, ("相談", "案内", "協会", "取引", "活動", "あっせん")))
    return False


def candidate(words: list, kind: str, rule: str, header: str, page: tuple, flags: dict, rect: tuple | None = None, n_lines: int = 1) -> dict | None:
    t, placed = joined(words), not rule.startswith("pattern")
    low, high = LENGTHS[kind]
    if not low <= len(t) <= high or unwanted(t, kind, flags, placed):
        return None
    r = rect or around(words)
    mx, my = MARGINS.get(kind, (0.15, 0.12))
    r = clipped(grown(r, height(r) * mx, height(r) * my), page)
    if r[2] - r[0] <= 1 or r[3] - r[1] <= 1:
        return None
    sure = "HIGH" if placed and _FORMATS[kind](t) else "MEDIUM" if placed else "LOW"
    return {"rule": rule, "kind": kind, "original": " ".join(w.text for w in words).strip(), "norm": t, "confidence": sure, "header": header, "n_lines": n_lines, "rect": r}


def beside_labels(rows: list[Line], page: tuple, flags: dict):
    for row in rows:
        for (label, kind), name in zip(LABEL_KINDS, LABEL_RULES):
            if label not in row.norm:
                continue
            own = [w for w in row.words if label in w.norm or (w.norm and w.norm in label)]
            edge = max((w.x1 for w in own), default=row.x0)
            words, rect = [w for w in row.words if w.x0 > edge + 20], None
            if not words and own:
                words = below_label(rows, row, own, kind)
                if words:
                    r = around(words)
                    tall = max(height(r), row.y1 - row.y0)
                    rect = clipped(grown(r, tall * 0.35, tall * 0.20), page)
            if len(joined(words)) > 90 or is_context(joined(words)):
                continue
            words = value_words(words, kind)
            if words:
                yield candidate(words, kind, f"label_value:{name}", label, page, flags, rect)


def below_label(rows: list[Line], row: Line, own: list, kind: str) -> list:
    left, right = min(w.x0 for w in own), max(w.x1 for w in own)
    wide = max(right - left, 1.0)
    for n in rows:
        if n.y0 <= row.y1:
            continue
        tall = height(n.rect)
        if n.y0 - row.y1 > 3 * tall or n.heading or is_label(n.norm):
            return []
        close = abs(n.x0 - left) <= max(wide, 4 * tall) or (n.x0 <= right + wide and n.x1 >= left - wide)
        words = value_words(n.words, kind) if close and not is_context(n.norm) else []
        if words and (kind != "銀行名" or is_bank(joined(words))):
            return words
    return []


def column_bounds(heads: list, at: int, page: tuple) -> tuple[float, float]:
    w = heads[at]
    wide = w.x1 - w.x0
    left = heads[at - 1].x1 if at else w.x0 - max(wide, 40) * 2.6
    right = heads[at + 1].x0 if at + 1 < len(heads) else page[2]
    left, right = max(page[0], left), min(page[2], right)
    if right - left < max(wide, 30):
        reach, centre = max(wide, 40) * 1.8, (w.x0 + w.x1) / 2
        left, right = max(page[0], centre - reach), min(page[2], centre + reach)
    return left, right


def side_by_side(a: tuple, b: tuple, lap: float, apart: float) -> bool:
    narrow = max(min(a[2] - a[0], b[2] - b[0]), 1.0)
    shared = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) / narrow
    return shared >= lap or abs((a[0] + a[2]) - (b[0] + b[2])) / 2 <= max(a[2] - a[0], b[2] - b[0], 1.0) * apart


def merged(items: list[tuple], at: int, used: set, up: float, down: float, lap: float, apart: float, fits) -> list[int]:
    """Numbers of up to three following (line, words) that carry on a value, each close under what is held so far."""
    held, words = [at], list(items[at][1])
    for i in range(at + 1, min(at + 4, len(items))):
        line, more = items[i]
        if i in used or not more:
            continue
        r, nxt = around(words), around(more)
        tall = max(height(r), line.y1 - line.y0)
        gap = line.y0 - r[3]
        if gap > down * tall or line.heading:
            break
        if gap < -up * tall or not side_by_side(around(items[held[-1]][1]) if lap < 0.2 else r, nxt, lap, apart) or not fits(words + more):
            continue
        held.append(i)
        words += more
    return held


def under_headers(rows: list[Line], page: tuple, flags: dict):
    def fits(kind):
        def test(words):
            t = joined(words)
            return len(words) <= 8 and (len(t) <= 80 and is_address(t) if kind == "住所" else len(t) <= 36 and is_company(t))

        return test

    for head in rows:
        heads = sorted((w for w in head.words if has(w.norm, (h for h, _ in COLUMN_KINDS)) or EXTRA_HEADERS.search(w.norm)), key=lambda w: w.x0 + w.x1)
        if len(heads) < 2:
            continue
        for (label, kind), name in zip(COLUMN_KINDS, COLUMN_RULES):
            at = next((i for i, w in enumerate(heads) if label in w.norm), None)
            if at is None:
                continue
            left, right = column_bounds(heads, at, page)
            items = []
            for n in rows:
                if n is head or n.cy <= head.cy + 0.4 * height(head.rect):
                    continue
                if n.y0 - head.y1 > 380 or (n.heading and n.y0 > head.y1 + 25):
                    break
                inside = [w for w in n.words if left <= (w.x0 + w.x1) / 2 <= right]
                if not inside and kind != "氏名":
                    inside = [w for w in n.words if w.x0 < right and w.x1 > left]
                items.append((n, inside))
            used: set = set()
            for i, (n, inside) in enumerate(items):
                if i in used or not inside:
                    continue
                held = [i] if kind == "氏名" else merged(items, i, used, 0.5, 1.65, 0.28, 0.55, fits(kind))
                used |= set(held)
                words = value_words([w for k in held for w in items[k][1]], kind)
                if words:
                    r = around(words)
                    tall = max(height(r), n.y1 - n.y0)
                    rect = (max(left, r[0] - 0.35 * tall), min(n.y0, r[1]) - 0.2 * tall, min(right, r[2] + 0.35 * tall), max(n.y1, r[3]) + 0.2 * tall)
                    yield candidate(words, kind, f"table_column:{name}", label, page, flags, clipped(rect, page), len(held))


def zone_of(head: Line, heads: list[Line], page: tuple) -> tuple[float, float]:
    band = [h for h in heads if h is not head and abs(h.cy - head.cy) <= 3 * height(head.rect)]
    left, right = [h.cx for h in band if h.cx < head.cx], [h.cx for h in band if h.cx > head.cx]
    return (max(left) + head.cx) / 2 if left else max(page[0], head.cx - 150), (min(right) + head.cx) / 2 if right else min(page[2], head.cx + 150)


def in_zone(n: Line, zone: tuple) -> bool:
    lap = min(n.x1, zone[1]) - max(n.x0, zone[0])
    return lap > 0 and (lap / max(n.x1 - n.x0, 1.0) >= 0.45 or zone[0] <= n.cx <= zone[1])


def section_rect(words: list, zone: tuple, page: tuple, kind: str) -> tuple:
    r = around(words)
    mx, my = (0.80, 0.60) if kind == "会社名" else (0.75, 0.24)
    g = grown(r, height(r) * mx, height(r) * my)
    return clipped((max(zone[0], g[0]), g[1], min(zone[1], g[2]), g[3]), page)


def may_start(n: Line, kind: str) -> bool:
    t = n.norm
    most, least = (18, 2) if kind == "会社名" else (8, 1)
    return not is_noise(t) and not is_context(t) and not (kind == "会社名" and has(t, PROCESS_WORDS)) and len(n.words) <= 4 and least <= japanese(t) <= most


def is_listed(n: Line, kind: str) -> bool:
    t = n.norm
    if kind == "氏名":
        return is_person(t) or ("役職" in t and japanese(t) >= 2)
    if is_misread(t) or MARKED.search(t):
        return bool(MARKED.search(t))
    if has(t, PROCESS_WORDS):
        return False
    short = n.words[0].text.strip().startswith(("・", "●", "-")) or len(n.words) <= 3
    return bool(MISREAD.search(t) and 4 <= len(t) <= 24) or (short and 4 <= japanese(t) <= 18 and not NUMERIC.match(t))


def below_headings(lines: list[Line], page: tuple, flags: dict):
    heads = [n for n in lines if n.heading]
    for head in heads:
        kind, rule = ("氏名", "section_block:person_list") if head.heading in PERSON_HEADINGS else ("会社名", "section_block:business_partner")
        zone = zone_of(head, heads, page)
        near = [n for n in lines if head.y1 + 4 < n.y0 <= head.y1 + 260 and not n.heading and in_zone(n, zone) and not is_label(n.norm) and not is_context(n.norm)]
        for n in near:
            words = value_words(n.words, kind)
            if words and is_listed(n, kind):
                yield candidate(words, kind, rule, head.heading, page, flags, section_rect(words, zone, page, kind))

        def fits(words, kind=kind):
            t = joined(words)
            low, high = (4, 30) if kind == "会社名" else (2, 10)
            return len(words) <= 7 and not is_context(t) and low <= len(t) <= high and _LOOKS[kind](t)

        items, used = [(n, n.words) for n in near], set()
        for i, n in enumerate(near):
            if i in used or not may_start(n, kind):
                continue
            held = merged(items, i, used, 0.4, 1.45, 0.18, 0.75, fits)
            used |= set(held)
            words = value_words([w for k in held for w in near[k].words], kind) if len(held) > 1 else []
            if words:
                yield candidate(words, kind, rule, head.heading, page, flags, section_rect(words, zone, page, kind), len(held))


def alone(lines: list[Line], page: tuple, flags: dict):
    told = ("取引銀行", "金融機関", "所在地", "住所", "販売先", "仕入先", "外注先", "会社名", "法人名")
    tests = (("会社名", "corporate_marker", "法人表記", lambda t: bool(MARKED.search(t))), ("住所", "address", "住所構成", is_whole_address), ("銀行名", "financial_institution", "金融機関表記", is_bank))
    for n in lines:
        if is_noise(n.norm) or is_label(n.norm) or (flags["financial"] and not has(n.norm, told)):
            continue
        hit = next((x for x in tests if x[3](n.norm)), None)
        words = value_words(n.words, hit[0]) if hit else []
        if words:
            yield candidate(words, hit[0], f"pattern:{hit[1]}", hit[2], page, flags)


def overlap_share(a: tuple, b: tuple) -> float:
    """Common area over the smaller of two."""
    area = lambda r: max(r[2] - r[0], 0.0) * max(r[3] - r[1], 0.0)
    common = (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    return area(common) / max(min(area(a), area(b)), 1.0)


def same_place(a: tuple, ta: str, b: tuple, tb: str, share: float = 0.78) -> bool:
    """Whether two candidates of a kind are one: they overlap, and a text holds the other or the centres are close."""
    if a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1] or overlap_share(a, b) < share:
        return False  # nothing in common, or not enough
    far = ((a[0] + a[2] - b[0] - b[2]) ** 2 + (a[1] + a[3] - b[1] - b[3]) ** 2) ** 0.5 / 2
    return ta in tb or tb in ta or far <= max(height(a), height(b))


def kept(found: list[dict]) -> list[dict]:
    """One of candidates with equal rounded places; of overlapping ones that of the higher family, then the smaller."""
    rank = lambda c: (FAMILIES.get(c["rule"].partition(":")[0], 0), -(c["rect"][2] - c["rect"][0]) * (c["rect"][3] - c["rect"][1]))
    out, seen = [], set()
    for c in found:
        key = (c["kind"], c["norm"], *map(round, c["rect"]))
        if key in seen:
            continue
        seen.add(key)
        at = next((i for i, k in enumerate(out) if k["kind"] == c["kind"] and same_place(k["rect"], k["norm"], c["rect"], c["norm"])), None)
        if at is None:
            out.append(c)
        elif rank(c) > rank(out[at]):
            out[at] = c
    return out


@lru_cache(maxsize=8)
def word_type(fields: tuple):
    return namedtuple("Word", [*fields, "norm"], rename=True)


def context_candidates(words: DataFrame, enabled=tuple(FAMILIES)) -> DataFrame:
    """Candidates of all pages of (word boxes, page_x0, page_y0, page_x1, page_y1); ``enabled`` names the families to run."""
    steps = {"label_value": (beside_labels, True), "table_column": (under_headers, True), "section_block": (below_headings, False), "pattern": (alone, False)}
    steps = {k: steps[k] for k in ("label_value", "table_column", "section_block", "pattern") if k in enabled}
    words = words.drop("norm").withColumn("block", F.coalesce("block", F.lit(0))).withColumn("line", F.coalesce("line", F.lit(0)))
    hits = {"financial": FINANCIAL_WORDS, "explanatory": EXPLANATORY_WORDS, "bank_guide": BANK_GUIDE_WORDS}

    def one(page_words):
        Word = word_type(page_words[0]._fields)
        every = [w for w in (Word(*r, norm(r.text or "")) for r in page_words) if w.norm]
        if not every:
            return
        first = page_words[0]
        page = tuple(map(float, (first.page_x0, first.page_y0, first.page_x1, first.page_y1)))
        lines = lines_of(every)
        rows, whole = rows_of(lines), "".join(n.norm for n in lines)
        flags = {k: sum(w in whole for w in ws) >= 2 for k, ws in hits.items()}
        found = [c for f, by_row in steps.values() for c in f(rows if by_row else lines, page, flags) if c]
        for c in kept(found):
            yield first.file_id, first.page, c["rule"], c["kind"], c["original"], c["norm"], c["confidence"], c["header"], c["n_lines"], *c["rect"]

    return by_page(words, ["block", "line", "word_no"], one, OUTPUT)


def text_area_ratio(words: DataFrame) -> DataFrame:
    """(file_id, page, area_ratio): the words' area over the page's, one at most."""
    side = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(0.0))
    page = F.first((F.col("page_x1") - F.col("page_x0")) * (F.col("page_y1") - F.col("page_y0")))
    return words.groupBy(*PAGE).agg(F.least(F.sum(side("x0", "x1") * side("y0", "y1")) / F.greatest(page, F.lit(1.0)), F.lit(1.0)).alias("area_ratio"))
