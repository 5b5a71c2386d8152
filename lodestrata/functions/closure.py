"""Snippet closure: growing a quoted passage to whole sentences of its source, with offsets."""

from __future__ import annotations

import re
import unicodedata

_DASHES = dict.fromkeys(map(ord, "‐‑‒–—―−"), "-") | dict.fromkeys(map(ord, "‘’‚′"), "'") | dict.fromkeys(map(ord, "“”„″"), '"')
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset("s ss art arts no nos cl cls reg regs sch para paras pt vol ch".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}


def folded(text: str) -> tuple[str, list[int]]:
    """The comparable form of a text (NFKC, plain dashes and quotes, single spaces, case folded, no soft
    hyphens) and, for each of its characters, the source character it comes from."""
    out, origin = [], []
    for at, char in enumerate(text):
        if char == "­":
            continue
        if char.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                origin.append(at)
            continue
        for c in unicodedata.normalize("NFKC", char).translate(_DASHES).casefold():
            if c.isspace():
                if out and out[-1] == " ":
                    continue
                c = " "
            out.append(c)
            origin.append(at)
    while out and out[-1] == " ":
        out.pop()
        origin.pop()
    return "".join(out), origin


def locate(snippet: str, source: str) -> tuple[int, int] | None:
    """Where the snippet stands in the source, compared in folded form."""
    wanted, _ = folded(snippet)
    text, origin = folded(source)
    at = text.find(wanted) if wanted else -1
    return None if at < 0 else (origin[at], origin[at + len(wanted) - 1] + 1)


#: List items and labels, what ends a passage openly, what may follow a list without belonging to it, and
#: how far ahead a list's next item may stand.
CHILD = re.compile(r"\(\s*(?:[a-z]|[ivxlcdm]{1,6})\s*\)", re.I)
LABEL = re.compile(r"(?<!\w)\(\s*(?:\d+[A-Z]?|[a-z]|[ivxlcdm]{1,6})\s*\)\s+", re.I)
CONNECTOR = re.compile(r"\b(?:and|or)\s*$", re.I)
REFERENCE_WORD = re.compile(r"\b(?:section|subsection|paragraph|subparagraph|article|regulation|schedule|clause|part)\s*$", re.I)
APART = re.compile(r"\s*(?:Explanation|Note|Example)\b", re.I)
REACH = 800
OPENERS = (":", "—", "–")
RANKS = {"section": 0, "subsection": 1, "paragraph": 2, "subparagraph": 3, "subsubparagraph": 4, "item": 2}
_BRACKETS = re.compile(r"[()\[\]{}]")


def ends_sentence(text: str, at: int) -> bool:
    """Whether the character at `at` stops a sentence: not a decimal point, an abbreviation or an initial."""
    if text[at] not in ".!?":
        return False
    if text[at] == ".":
        word = re.search(r"\S*$", text[max(0, at - 16) : at])[0]
        decimal = 0 < at < len(text) - 1 and text[at - 1].isdigit() and text[at + 1].isdigit()
        if decimal or word.lower() in ABBREVIATIONS or re.fullmatch("[A-Z]", word):
            return False
    return at + 1 == len(text) or bool(re.match(r"[\])}\"'’”]*\s", text[at + 1 : at + 8]))


class Brackets:
    """Follows the brackets of a text stretch by stretch, so that each is looked at once."""

    def __init__(self):
        self.open: list[str] = []
        self.broken = False

    def read(self, text: str) -> bool:
        """Whether all that was read is balanced."""
        for m in _BRACKETS.finditer(text):
            if m[0] in _PAIRS:
                self.broken |= not self.open or self.open.pop() != _PAIRS[m[0]]
            else:
                self.open.append(m[0])
        return not self.broken and not self.open


def balanced(text: str) -> bool:
    return Brackets().read(text)


def open_ending(text: str) -> str | None:
    """Why a text can't end where it does; null if it can."""
    end = text.rstrip().rstrip("\"'’”)]}")
    if end.endswith(OPENERS):
        return "FAIL_OPEN_LIST"
    if CONNECTOR.search(end) or REFERENCE_WORD.search(end):
        return "FAIL_DANGLING_CONNECTOR"
    return None if balanced(text) else "FAIL_UNBALANCED_STRUCTURE"


def passage_start(source: str, at: int) -> int:
    """Where the passage of a place begins: behind the last stop, or an empty line after it; at the last label from
    there on, unless what introduces that label needs it."""
    begin = next((k + 1 for k in range(at - 1, -1, -1) if ends_sentence(source, k)), 0)
    empty = source.rfind("\n\n", begin, at)
    begin = empty + 2 if empty >= 0 else begin
    begin += len(source[begin:at]) - len(source[begin:at].lstrip())
    labels = [m.start() for m in LABEL.finditer(source, begin, at)]
    before = source[begin : labels[-1]].rstrip() if labels else ""
    return labels[-1] if labels and not before.endswith(OPENERS) and not CONNECTOR.search(before) else begin


def children_end(snippet: str, source: str, end: int, blocks: list[dict] | None) -> int:
    """The least end of a passage whose block introduces a list: that of the list's last block of lower rank."""
    said, texts = folded(snippet)[0], [folded(b.get("text") or "")[0] for b in blocks or []]
    owner = next((k for k, t in enumerate(texts) if said in t or t in said), None)
    if owner is None or (":" not in (blocks[owner].get("text") or "") and not snippet.rstrip().endswith(":")):
        return end
    kind = lambda b: RANKS.get((b.get("class") or "").casefold())
    top, last = kind(blocks[owner]), None
    for b in blocks[owner + 1 :]:
        rank = kind(b)
        if (rank is None and not CHILD.match((b.get("text") or "").strip())) or (rank is not None and rank <= (1 if top is None else top)):
            break
        last = b
    found = last and locate(last.get("text") or "", source[end:])
    return end + found[1] if found else end


def close(snippet: str, source: str, hard: int = 3000, soft: int = 700, blocks: list[dict] | None = None) -> tuple[str, int | None, int | None, str | None]:
    """(code, start, end, text): the snippet grown left to its passage's beginning and right to the first stop at which
    all brackets are closed and no further item of a list that a colon introduces is near.

    Without such a stop the rest of the source is given, with what leaves it open.  blocks(class, text): the source's
    parts in their order, where they are known."""
    found = locate(snippet, source)
    if found is None:
        return "FAIL_UNBALANCED_STRUCTURE", None, None, None
    start = passage_start(source, found[0])
    at = max(start, children_end(snippet, source, found[1], blocks) - 1)
    colon = source.find(":", start)
    child = CHILD.search(source, colon + 1) if colon >= 0 else None
    brackets, read = Brackets(), start
    for stop in re.finditer(r"[.!?]", source[at:]):
        upto = at + stop.end()
        if not ends_sentence(source, upto - 1):
            continue
        whole = brackets.read(source[read:upto])
        read = upto
        if brackets.broken:
            break
        listed = child is not None and child.end() <= upto
        if whole and not (listed and not APART.match(source[upto : upto + REACH]) and CHILD.search(source, upto, upto + REACH)):
            text = source[start:upto]
            code = open_ending(text) or ("FAIL_CLOSURE_OVER_HARD_LIMIT" if len(text) > hard else "PASS_LONG_BUT_CLOSED" if len(text) > soft else "PASS_CLOSED")
            return code, start, upto, text
    text = source[start:].rstrip()
    return open_ending(text) or "FAIL_UNBALANCED_STRUCTURE", start, start + len(text), text


def g9(code: str) -> str:
    """The gate's verdict on a closure."""
    return "PASS" if code.startswith("PASS_") else "FAIL"
