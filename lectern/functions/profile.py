"""Settings per script: which characters count, which letters are confused, where a verse ends."""

from __future__ import annotations

from dataclasses import dataclass


# Letter pairs easily confused in the Hebrew script, symmetric.
HEBREW_CONFUSABLE = (
    "בכ בנ כנ גנ דר דך רך הח הת חת וז וי ון זן םס םמ צץ פף כך נן עצ טמ שע אצ לך גז קה"
)
# The letters of the Hebrew alphabet, final forms last.
HEBREW_LETTERS = "אבגדהוזחטיכלמנסעפצקרשתךםןףץ"
# Vowel, cantillation and invisible control marks that are dropped.
HEBREW_MARKS = r"[\u0591-\u05BD\u05BF-\u05C7\u200B-\u200F\u202A-\u202E\u2060\uFEFF]"
# Joining dashes that separate words.
DASHES = r"[\u05BE\u2010-\u2015\-]"


@dataclass(frozen=True)
class Profile:
    name: str
    letters: str
    """Body of a regex character class."""
    marks: str
    dashes: str = DASHES
    lowercase: bool = False
    confusable: tuple[str, ...] = ()
    """Two-letter strings; each pair counts both ways."""
    end_mark: str = "."
    """A raw word holding it ends a verse."""
    alphabet: str = ""
    """Letters that random edits draw from."""
    editorial: tuple[str, ...] = ()
    """Patterns removed by `written_text`; each begins with `editorial_sign`."""
    editorial_sign: str = "#"

    @property
    def confusable_both(self) -> tuple[str, ...]:
        return tuple(sorted({p for q in self.confusable for p in (q, q[::-1])}))

    def canonical_letters(self) -> tuple[str, str]:
        """Two aligned strings for `translate`: every letter of a connected confusable group maps to one letter."""
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for a, b in self.confusable:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
        src = sorted(c for c in root if find(c) != c)
        return "".join(src), "".join(find(c) for c in src)


HEBREW = Profile(
    name="hebrew",
    letters="א-ת",
    marks=HEBREW_MARKS,
    confusable=tuple(HEBREW_CONFUSABLE.split()),
    end_mark="\u05c3",
    alphabet=HEBREW_LETTERS,
    editorial=(r"#\[[^\]]*\]", r"#\(פ\)"),
)

LATIN = Profile(
    name="latin",
    letters=r"\p{L}",
    marks=r"[\u200B-\u200F\u202A-\u202E\u2060\uFEFF]",
    lowercase=True,
    alphabet="abcdefghijklmnopqrstuvwxyz",
    editorial=(r"#\[[^\]]*\]", r"#\(p\)"),
)
