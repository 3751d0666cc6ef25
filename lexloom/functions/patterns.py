"""Patterns in Java's syntax, with the group numbers of their parts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """What saves the scan of a text. ``any_of``: strings of which a text with a match holds one as it is written; ``needs``: a
    lower-case string without which a text (in lower case) has no match; ``hint``: a quick pattern likewise."""

    regex: str
    parts: tuple[str, ...] = ()
    needs: str = ""
    hint: str = ""
    any_of: tuple[str, ...] = ()


def _cases(a: str, b: str, tail: str = "") -> tuple[str, ...]:
    """Two letters in all spellings that a pattern without regard to case takes for them."""
    return tuple(x + y + tail for x in a for y in b)


# What a pattern looks ahead for at its beginning ((?=...)) follows from the rest: a quick test before the search for a boundary.
# Patterns and characters that results depend on.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u202a\u202b\u202c\u202d\u202e"
BIDI = "\u202a\u202b\u202c\u202d\u202e"
CASE = Pattern(r"(?U)([A-Z][^;\n]{1,100}?\s+v\.\s+[A-Z][^,;\n]{1,100}?),\s*(\d{1,4})\s+([A-Za-z][A-Za-z.\d ]{0,18}?)\s+(\d{1,6})(?:,\s*(\d{1,6}(?:[-–]\d{1,6})?))?\s*\(([^)]*\d{4})\)", ("case_name", "volume", "reporter", "first_page", "pincite", "court_year"), needs="v.", hint=r"(?U)\sv\.\s+[A-Z]")
STATUTE = Pattern(r"(?iuU)(?=\d)\b(\d+)\s+(U\.?\s*S\.?\s*C\.?)\s*(§{1,2})\s*([\w.\-()]+)", ("title", "code", "symbol", "section"), needs="§", hint=r"(?U)[Uu]\.?\s*[Ssſ]\.?\s*[Cc]\.?\s*§")
REGULATION = Pattern(r"(?iuU)(?=\d)\b(\d+)\s+(C\.?\s*F\.?\s*R\.?)\s*(§{1,2})\s*([\w.\-()]+)", ("title", "code", "symbol", "section"), needs="§", hint=r"(?U)[Cc]\.?\s*[Ff]\.?\s*[Rr]\.?\s*§")
CONSTITUTION = Pattern(r"(?iuU)(?=U\.S)\bU\.S\. Const\.\s+((?:art\.|amend\.)\s+[IVXLCDM\d]+(?:,\s*§\s*\d+)?)", ("subdivision",), needs="const.", any_of=("S. ", "s. ", "ſ. "))
JOURNAL = Pattern(r"(?U)(?=\d)\b(\d{1,3})\s+([A-Z][A-Za-z.&'\- ]+L\.?\s*J\.?|[A-Z][A-Za-z.&'\- ]+L\.?\s*Rev\.?)\s+(\d{1,5})\b", ("volume", "journal", "page"), hint=r"(?U)L\.?\s*(?:J|Rev)", any_of=("J", "Rev"))
SHORT_FORM = Pattern(r"(?iuU)(?=[sh])\b(supra|hereinafter)\b", ("form",), hint=r"(?iu)supra|hereinafter", any_of=_cases("pP", "rR") + _cases("fF", "tT"))
ID = Pattern(r"(?iuU)(?=id)(?<!\w)(id)\.?(?!\w)", ("form",), any_of=_cases("iIıİ", "dD"))
#: Where a match of ID can begin that is not written "Id.".
ODD_ID = r"(?uU)(?<!\w)(?!Id\.(?!\w))(?i:id)(?!\w)"
URL = Pattern(r"(?U)https?://[^\s<>\])}]+", needs="http")
REPORTER = Pattern(
    r"(?iuU)(?=\d)\b(\d{1,4})\s+(U\s{0,2}\.?\s{0,2}S\s{0,2}\.?|S\s{0,2}\.?\s{0,2}Ct\s{0,2}\.?|F\s{0,2}\.?\s{0,2}(?:Supp\s{0,2}\.?\s{0,2}(?:2d|3d)?|2d|3d)|F\s{0,2}\.|L\s{0,2}\.?\s{0,2}Ed\s{0,2}\.?\s{0,2}(?:2d)?)\s+(\d{1,6})\b",
    ("volume", "reporter", "page"),
    hint=r"(?U)\d\s+[UuSsſFfLl]",
)
STATE_REPORTERS = ("Ala.", "Ariz.", "Ark.", "Cal.", "Cal. 2d", "Cal. 3d", "Cal. 4th", "Cal. 5th", "Cal. App.", "Cal. App. 2d", "Cal. App. 3d", "Cal. App. 4th", "Cal. App. 5th", "Conn.", "Ga.", "Ill.", "Ill. 2d", "Ind.", "Iowa", "Kan.", "Ky.", "La.", "Mass.", "Md.", "Me.", "Mich.", "Minn.", "Mo.", "N.C.", "N.J.", "N.M.", "N.Y.", "N.Y.2d", "N.Y.3d", "Neb.", "Nev.", "Ohio St.", "Ohio St. 2d", "Ohio St. 3d", "Or.", "Pa.", "S.C.", "Tenn.", "Tex.", "Va.", "Vt.", "Wash.", "Wash. 2d", "Wis.", "Wis. 2d", "W. Va.")
FEDERAL_REPORTERS = ("U.S.", "US", "S. Ct.", "L. Ed.", "L. Ed. 2d", "F.", "F.2d", "F.3d", "F.4th", "F. Supp.", "F. Supp. 2d", "F. Supp. 3d", "F. App'x", "Fed. Cl.", "A.", "A.2d", "A.3d", "P.", "P.2d", "P.3d", "N.E.", "N.E.2d", "N.E.3d", "N.W.", "N.W.2d", "S.E.", "S.E.2d", "S.W.", "S.W.2d", "S.W.3d", "So.", "So. 2d", "So. 3d", "N.Y.S.", "N.Y.S.2d", "N.Y.S.3d", "Cal. Rptr.", "Cal. Rptr. 2d", "Cal. Rptr. 3d")
NOT_A_PARTY = ("See", "But", "Cf.", "Compare", "Accord", "Contra", "Also", "In", "The", "Under", "And", "With", "Id.", "Ibid.", "E.g.", "As")
CODE_WORDS = ("Code Ann.", "Code", "Gen. Laws", "Gen. Stat.", "Comp. Laws", "Comp. Stat.", "Rev. Stat.", "Rev. Code", "Stat. Ann.", "Stat.", "Law")
CONNECTORS = ("of", "the", "and", "for", "in", "ex", "rel.", "&", "de", "la")
ID_PINCITE_AFTER = r"(?iuU)^\s*,?\s*at\s+\d"
SIGNAL_BEFORE_ID = r"(?iuU)\b(?:see also|see generally|but see|but cf\.?|see|cf\.?|accord|compare|e\.g\.)\s*$"
SENTENCE_END_BEFORE = r"(?U)[.!?][\"'”)\]]?\s*$"
ID_WINDOW = 500
SHORT_CASE = Pattern(r"(?U)(?=[A-Z])\b([A-Z][A-Za-z0-9.&' -]{1,50}),\s*(\d{1,4})\s+(U\.S\.|F\.(?:2d|3d|Supp\.?(?: 2d| 3d)?))\s+at\s+(\d{1,6}(?:[-–—]\d{1,6})?)\b", ("name", "volume", "reporter", "pincite"), needs="at", hint=r"(?U)(?:U\.S\.|F\.(?:2d|3d|Supp\.?(?: 2d| 3d)?))\s+at\s+\d")
ID_FORM = Pattern(r"(?iuU)(?=Id\.)\bId\.(?:\s+at\s+\d{1,6}(?:[-–—]\d{1,6})?)?", any_of=_cases("iIıİ", "dD", "."))
SUPRA_NOTE = Pattern(r"(?iuU)(?=[A-Z])\b([A-Z][A-Za-z0-9.&' -]{0,60}?),\s+supra\s+note\s+(\d+)(?:,\s*at\s+\d{1,6}(?:[-–—]\d{1,6})?)?", ("label", "note"), needs="supra", hint=r"(?iuU)supra\s+note", any_of=_cases("pP", "rR"))
SUPRA = Pattern(r"(?iuU)(?=[A-Z])\b([A-Z][A-Za-z0-9.&' -]{0,60}?),\s+supra(?:,\s*at\s+\d{1,6}(?:[-–—]\d{1,6})?)?", ("label",), needs="supra", any_of=_cases("pP", "rR"))
STATUTORY_SHORT = Pattern(r"(?iuU)(?=[UC§])(?:(U\.?\s*S\.?\s*C\.?|C\.?\s*F\.?\s*R\.?)\s+)?(?<![A-Za-z.\d])§{1,2}\s*([\w.()\-]+)", ("code", "section"), needs="§")
HEREINAFTER = Pattern(r"(?iuU)\(hereinafter\s+[“\"]([^”\"]+)[”\"]\)", ("alias",), needs="(hereinafter", any_of=("(h", "(H"))
TRAILING_HEREINAFTER = r"(?iuU)\s*\(hereinafter\s+[“\"][^”\"]+[”\"]\)\s*\z"
JOURNAL_AFTER = r"(?U)\A(?:,\s*(\d{1,6}(?:[-–]\d{1,6})?)(?!\d))?(?:\s*\((\d{4})\))?"
NAME_BEFORE = r"(?U)([A-Z][\w.'’-]*),?\s*\z"
GAP_SENTENCE_BREAK = r"(?U)\.\s+[A-Z]"
GAP_WORD = r"[A-Za-z]{3,}"
GAP_AUTHORITY = r"(?U)\bv\.\s|\b\d{1,4}\s+(?:(?:[A-Z]\.){1,3}|[A-Z][a-z]{0,3}\.)|§|\bsupra\b|\bId\.\B"
EDGE_SIGNAL = r"(?iuU)\b(see also|see|cf\.|accord|but see|contra)\s*$"
EDGE_QUOTE = r"(?U)[“\"][^”\"]+[”\"]\s*$"
EDGE_PARENTHETICAL = r"(?U)^\s*\([^)]{2,160}\)"
SIGNAL = Pattern(r"(?iuU)(?<!\w)(compare|with|see also|see generally|see|cf\.?|accord|but see|but cf\.?|contra)\s+", ("signal",))
COURT_YEAR = r"(?U)^[A-Za-z.\d'&,\- ]{0,40}\b(?:1[6-9]|20)\d{2}[a-z]?$"
QUOTED_BEFORE = r"(?U)[“\"]([^”\"]{2,220})[”\"](?:\s+[^.;]{0,30})?\s*$"
ARTICLE_BEFORE = r"(?U)([A-Z][A-Za-z.' -]+),\s*([^,]{2,100}),\s*$"
YEAR_AFTER = r"(?U)\((\d{4})\)"
CITATION_HINT = r"(?iuU)(?:\b\d+\s+(?:U\.?\s*S\.?\s*C\.?|C\.?\s*F\.?\s*R\.?|U\.?\s*S\.?|F\.?\s*(?:2d|3d|Supp\.?))\b|\bv\.\s|\b(?:Id\.|supra)\b)"
PARAGRAPH = Pattern(r"(?sU)\S(?:.*?\S)?(?=\n\s*\n|\s*\z)")
NUMBERED_NOTE = r"(?U)^\[(\d+)\]\s+"
MARKDOWN_NOTE = r"(?U)^\[\^([^\]]+)\]:\s*"
NOTE_REFERENCE = Pattern(r"(?U)\[(\d+)\]", ("note",), needs="[")
MARKDOWN_REFERENCE = Pattern(r"\[\^([^\]]+)\](?!:)", ("note",), needs="[^")
MARKDOWN_DEFINITION = Pattern(r"(?mdU)^\[\^([^\]]+)\]:\s*(.*(?:\n(?: {2,}|\t).*)*)$", ("note", "body"))
MARKDOWN_PARAGRAPH = Pattern(r"(?mdU)^(?!\s*$).+(?:\n(?!\s*$).+)*")
MARKDOWN_LINK = Pattern(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", ("label", "url"))
HEADING_MARK = r"^#{1,6}\s+"
SENTENCE = Pattern(r"(?dU)[^\n]+?(?:[!?](?=\s|$)|\.(?=\s|$)|$)")
QUOTATION = Pattern(r"[“\"]([^”\"]+)[”\"]", ("quoted",))
FILING_WORDS = r"(?iuU)\b(?:district|superior|bankruptcy) court\b|\bplaintiff\b|\bdefendant\b|\bmotion\b|\bpetitioner\b|\brespondent\b|\bon writ of certiorari\b|\bbrief (?:for|of)\b"
ACADEMIC_WORDS = r"(?iuU)\blaw review\b|\bseminar paper\b|\bthis (?:article|note)\b|\bscholarly\b"
BYLINE = r"(?md)^[ \t]*By[ \t]+[A-Z][a-zA-Z'.-]*(?:[ \t]+[A-Z][a-zA-Z'.-]*){1,3}[ \t]*$"
BLUE_TYPES = ("brief", "motion", "pleading", "court_filing", "legal_memorandum", "memorandum", "practitioner")
WHITE_TYPES = ("law_review", "law_review_article", "journal_article", "seminar_paper", "academic", "student_note")
PERMITTED_SUPRA = ("journal_article", "book", "court_document", "administrative", "internet", "archival", "foreign_international_tribal", "ai_content", "unknown")
SUBSTANTIVE = ("case", "statute", "regulation", "constitution", "journal_article")


def _any(words: tuple[str, ...]) -> str:
    """An alternation, longest first, with optional space after a period and at a space."""
    import re

    return "|".join(re.escape(w).replace(r"\ ", r"\s?").replace(r"\.", r"\.") for w in sorted(words, key=len, reverse=True))


def _by_letter(words: tuple[str, ...]) -> str:
    """``_any``, but only the words that begin with the letter at hand are tried."""
    return "|".join(f"(?={a})(?:{_any(tuple(w for w in words if w[0] == a))})" for a in sorted({w[0] for w in words}))


_WORD = r"(?:[A-Z][\w&'’-]*|[A-Z][A-Za-z]{0,3}\.|(?:[A-Z]\.)+)"
_PARTY = rf"{_WORD}(?:,? (?:{_any(CONNECTORS)}|{_WORD})){{0,8}}"

#: What a text holds that has an edge of a clause; of a signal, a quotation or a parenthetical; an antecedent of a section's short form and that form.
CLAUSE_EDGE = Pattern(";", needs=";")
CONTEXT_EDGE = Pattern(r"(?iu)see|cf\.|accord|contra|[“\"”(]", hint=r"(?iu)see|cf\.|accord|contra|[“\"”(]")
TWO_SECTIONS = Pattern(r"§[^§]+§", needs="§", hint=r"§[^§]+§")

#: Case citations by a table of reporters: with or without a name, a pincite, a court and a year (also the year after the name).
REPORTED_CASE = Pattern(
    rf"(?U)(?=[A-Z\d])(?:(?<![\w.])(?!(?:{_any(NOT_A_PARTY)})[ ])({_PARTY} v\. {_PARTY})(?: \((\d{{4}})\)|,) )?\b(\d{{1,4}}) ({_any(STATE_REPORTERS + FEDERAL_REPORTERS)})\s?(?<![\w])(\d{{1,6}})\b(?!\s+(?:U\.?S\.?C|C\.?F\.?R))(?:, (\d{{1,6}}(?:[-–]\d{{1,6}})?)\b(?! [A-Z]))?(?: \((?:[A-Z][a-z]{{2,8}}\.? \d{{1,2}}, (\d{{4}})|([^()]*?)\s?(\d{{4}}))\))?",
    ("case_name", "inline_year", "volume", "reporter", "first_page", "pincite", "date_year", "court", "year"),
    hint=rf"(?U)\d (?:{_by_letter(STATE_REPORTERS + FEDERAL_REPORTERS)})\s?\d",
)
#: State statutes by the words their codes' names end in.
STATE_LAW = Pattern(rf"(?U)(?=[A-Z])\b((?:[A-Z][a-z]{{2,6}}\.|[A-Z]\.[A-Z]\.)(?: [A-Z][\w.&]*){{0,3}}? (?:{_any(CODE_WORDS)}))(?: (?:ch|tit)\. (\w+),)? §{{1,2}} ?([\w-]+(?:[.:][\w-]+)*)(?: \((?:[^()\d]*)(\d{{4}})\))?", ("code", "chapter", "section", "edition"), needs=" §", hint="(?:[esw,]|[nt]\\.) §")
