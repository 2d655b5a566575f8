"""Quality rules, line first.

Each \\n-separated line with a word is judged by itself: rules on punctuation, navigation
(separators, menu words) and boilerplate in four languages. Failing lines go; a document that loses too large a share of its words goes
with them, as do documents that fail the base rules (too short, too much repeated text).

Cases: a null text has no words, fails the base and has the empty cleaned text; lines without
a word are kept and judge nothing; repeated rows are judged one by one; an empty table gives
no rows; texts of any length are read whole; input columns named like a new one are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, encoded, field

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Phrases (A-Z in lower case) of licence, legal and web page boilerplate in English, Spanish, French and German.
BOILERPLATE = [
    "all rights reserved", "licensed under", "released under the", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here", "sign in to", "subscribe to our", "powered by",
    "todos los derechos reservados", "de privacidad", "de cookies", "aviso legal", "haga clic", "habilite javascript",
    "tous droits réservés", "de confidentialité", "mentions légales", "cliquez ici", "activez javascript",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "klicken sie hier", "aktivieren sie javascript",
]
#: Separators of menus.
SEPARATORS = "|›»→•·"
#: Words (A-Z in lower case) of menus.
MENU = ["home", "menu", "login", "logout", "register", "contact", "about", "help", "search", "next", "previous", "sitemap", "inicio", "contacto", "ayuda", "buscar", "accueil", "connexion", "aide", "rechercher", "startseite", "anmelden", "kontakt", "hilfe", "suche", "impressum"]
_BOILERPLATE, _SEPARATORS, _MENU = [p.encode() for p in BOILERPLATE], [c.encode() for c in SEPARATORS], {w.encode() for w in MENU}
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Rules:
    """All shares are in percent of a line's or document's words."""

    min_words: int = 20
    max_repeat: int = 30
    max_symbols: int = 50
    max_bars: int = 25  #: separators
    max_menu: int = 50
    max_bangs: int = 50
    long_line: int = 40
    min_kept: int = 60


def failing(line: bytes, words: int, rules: Rules) -> bool:
    """Whether a line with that many words fails."""
    if 100 * (len(line) - len(line.translate(None, SYMBOLS))) > rules.max_symbols * words:
        return True
    if 100 * sum(map(line.count, _SEPARATORS)) > rules.max_bars * words or 100 * line.count(b"!") > rules.max_bangs * words:
        return True
    if words >= rules.long_line and len(line) == len(line.translate(None, b".,;:!?")):
        return True
    low = line.translate(LOWER)
    if 100 * sum(w in _MENU for w in low.split()) > rules.max_menu * words:
        return True
    return any(phrase in low for phrase in _BOILERPLATE)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    text = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, w: a + w + 1))
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    windows = [text[a:b] for a, b in zip(starts, ends[WINDOW - 1 :])]
    if len(set(windows)) == n:
        return 0
    count, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def judge(text: str | None, rules: Rules) -> dict:
    data = encoded(text)
    words = data.split()
    n = len(words)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = data.split(b"\n")
    seen, dup, lost, kept_lines = set(), 0, 0, []
    for line in lines:
        k = len(line.split())
        if not k:
            kept_lines.append(line)
            continue
        dup += line in seen
        seen.add(line)
        if failing(line, k, rules):
            lost += k
        else:
            kept_lines.append(line)
    repeat = repeated_words(words)
    base_failed = n < rules.min_words or 100 * repeat > rules.max_repeat * n
    joined = b"".join(words).decode("utf-8", "surrogatepass")
    kept = not base_failed and 100 * (n - lost) >= rules.min_kept * n
    clean = b"\n".join(kept_lines).decode("utf-8", "surrogatepass") if lost else text or ""
    return {"n_words": n, "word_chars": len(joined), "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": base_failed, "kept": kept, "n_words_cleaned": n - lost, "cleaned": clean}


LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = [*[field(n, T.LongType()) for n in LONGS], field("base_failed", T.BooleanType()), field("kept", T.BooleanType()), field("n_words_cleaned", T.LongType()), field("cleaned", T.StringType())]


def judge_quality(df: DataFrame, text_col: str = "text", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """df with the statistics, the verdict and, with_text, the text without its failing lines."""
    fields = FIELDS if with_text else FIELDS[:-1]

    def make():
        def work(texts: list) -> dict:
            found = [judge(t, rules) for t in texts]
            return {f.name: [x[f.name] for x in found] for f in fields}

        return work

    return append_columns(df, text_col, make, fields)


def clean_documents(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", rules: Rules = Rules()) -> DataFrame:
    """The documents kept, in df's columns, without their failing lines."""
    names = df.columns
    # a prefix keeps the new columns apart from any of df's
    plain = df.select(*[F.col(f"`{n}`").alias(f"in_{i}") for i, n in enumerate(names)])
    text = f"in_{names.index(text_col)}"
    judged = judge_quality(plain, text, rules).where("kept")
    made = {text_col: F.col("cleaned")}
    if chars_col in names:
        made[chars_col] = F.length("cleaned").cast(df.schema[chars_col].dataType)
    return judged.select(*[made.get(n, F.col(f"in_{i}")).alias(n) for i, n in enumerate(names)])
