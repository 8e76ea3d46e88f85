"""Rules for names. They act on short lists of column names, never on rows."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Sequence


def clean_names(names: Iterable[str]) -> list[str]:
    """Lower-case ASCII names with underscores, made unique by a number.

    ``"Não sabe (%)"`` becomes ``nao_sabe_percent``; a leading digit gets an
    ``x``; the second ``a`` becomes ``a_2``.
    """
    seen: Counter[str] = Counter()
    taken: set[str] = set()
    out = []
    for name in names:
        text = name.replace("%", "_percent_").replace("#", "_number_").replace("'", "")
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
        text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
        text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
        if not text or text[0].isdigit():
            text = "x" + text
        seen[text] += 1
        name = text if seen[text] == 1 else f"{text}_{seen[text]}"
        while name in taken:
            seen[text] += 1
            name = f"{text}_{seen[text]}"
        taken.add(name)
        out.append(name)
    return out


def repair_names(names: Sequence[str]) -> list[str]:
    """Every repeated name gets ``...position``, counting columns from one."""
    counts = Counter(names)
    return [
        f"{name}...{position}" if counts[name] > 1 or not name else name
        for position, name in enumerate(names, start=1)
    ]


def group_name(slots: Sequence[str]) -> str:
    """Name of an unnamed multiple-response group: its first slot plus ``mrg``,
    with the first ``_number`` taken out (``v5_1`` gives ``v5mrg``)."""
    return re.sub(r"_\d+", "", f"{slots[0]}mrg", count=1)


def names_a_mean(variable: str) -> bool:
    """By convention a variable to be averaged has a name ending in ``m``."""
    return variable.endswith("m")


def without_mention_suffix(variable: str) -> str:
    """The variable name without its first ``_citou`` mark."""
    return variable.replace("_citou", "", 1)
