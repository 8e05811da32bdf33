"""Script profiles: what the text operators take to be a letter, a word, a stop word and the end of a sentence."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScriptProfile:
    name: str
    block: str  # inside of a character class
    least_term: int  # letters of a query term
    stopwords: tuple[str, ...]
    ender: str  # inside of a character class
    sentence: str  # what a text with sentences holds
    digits: str = "0123456789"

    @property
    def letter(self) -> str:
        return f"[{self.block}]"

    def words(self, least: int) -> str:
        return f"[{self.block}]{{{least},}}"


#: Devanagari stop words, marks and finite verb endings.
DEVANAGARI = ScriptProfile(
    "devanagari", "ऀ-ॿ", 2,
    tuple("का के की को कि में से और पर यह जो है ने भी एक था the a an is in of to and or for with on at by".split()),
    "।.!?", "।|॥|(?:है|हैं|था|थी|थे|हुआ|हुई|होता|होती|करते|करना|चाहिये|चाहिए|गया|गयी|रहता|रहती)(?:[\\s।॥,.]|$)", "०१२३४५६७८९",
)
LATIN = ScriptProfile(
    "latin", "A-Za-zÀ-ÿ", 3,
    tuple("the and for with that this from are was were has have not but you all any can had her his der die das und ist les des une est que los las por con del".split()),
    ".!?", "[.!?](?:\\s|$)",
)
