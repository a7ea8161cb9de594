"""Allow and block rules for image addresses, matched all at once by a bit-parallel wildcard automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mesograph.llm.common import ascii_lower, own_name

CHUNK_BYTES = 1 << 24


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Automaton:
    """Shift-And over packed patterns: one bit per pattern position in 64-bit words, every pattern behind the other.

    A rule becomes two globs, `host/path**` and `**.host/path**` with the leading stars held inside the host.  `*` in a rule is
    any run of bytes but `/`, `**` any run.  Bit 0 of a pattern is its start; a byte moves bits up by one where the next position
    has that byte, and keeps them where a star stands.  A pattern fits when its last bit is set after the last byte.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        globs = []
        for number, rule in enumerate(self.rules):
            body = self._positions(rule.text.encode())
            globs += [(number, [], body), (number, [(None, "*"), (ord("."), "")], body)]
        size = sum(1 + len([p for p in [*head, *body] if p[0] is not None]) for _, head, body in globs)
        self.words = max(1, -(-size // 64))
        step, stay = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        start, self.ends, at = np.zeros(self.words * 64, bool), [], 0
        within = np.arange(256) != ord("/")
        for number, head, body in globs:
            start[at] = True
            for byte, star in [*head, *body, (None, "**")]:
                if byte is None:
                    stay[:, at] |= within if star == "*" else True
                else:
                    at += 1
                    step[byte, at] = True
            self.ends.append((number, at))
            at += 1
        self.step, self.stay, self.start = (self._packed(x) for x in (step, stay, start[None]))
        # The longest rule wins; of equally long ones the first in the list.
        self.ends.sort(key=lambda e: (-len(self.rules[e[0]].text.encode()), e[0]))

    @staticmethod
    def _positions(glob: bytes) -> list[tuple[int | None, str]]:
        out: list[tuple[int | None, str]] = []
        for byte in glob:
            if byte != ord("*"):
                out.append((byte, ""))
            elif out and out[-1] == (None, "*"):
                out[-1] = (None, "**")
            elif not out or out[-1][0] is not None:
                out.append((None, "*"))
        return out

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """The number of the winning rule for each text, -1 for none."""
        best = np.full(len(texts), -1)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):  # texts of like length side by side, so the padded block stays small
            rows = max(1, CHUNK_BYTES // max(1, int(lengths[order[at]]) + 8 * self.words))
            chosen = order[at:at + rows]
            best[chosen] = self._block([texts[i] for i in chosen], lengths[chosen])
            at += rows
        return best

    def _block(self, texts: list[bytes], lengths: np.ndarray) -> np.ndarray:
        width = int(lengths[0])
        data = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
        state = np.repeat(self.start, len(texts), axis=0)
        active = np.searchsorted(-lengths, -np.arange(width), side="left")  # texts longer than the position
        for i in range(width):
            byte, now = data[:active[i], i], state[:active[i]]
            up = now << np.uint64(1)
            up[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active[i]] = (up & self.step[byte]) | (now & self.stay[byte])
        best = np.full(len(texts), -1)
        for number, bit in self.ends:
            hit = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
            best[(best < 0) & (hit > 0)] = number
        return best


def host_and_path(address: Column) -> tuple[Column, Column]:
    """Host after the first `://` up to `/`, `?`, `#` or the end, in lower case A-Z; path from there up to `?`, `#` or the end."""
    known = F.coalesce(address, F.lit(""))
    mark = F.instr(known, "://")
    rest = F.when(mark > 0, F.substring(known, mark + 3, F.length(known))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_addresses(images: DataFrame, rules: Sequence[Rule], path: str = "path", default: str = "allow") -> DataFrame:
    """Add host, path_in_host, rule and verdict to images (image_id, path), the path being an address such as `https://host/folder/cell.tif`.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule (host and path together)
    wins, of equally long ones the first.  Addresses that no rule fits get `default` and a null rule.  A null address, or one
    without `://`, has an empty host and path.  Every row is judged by itself without a shuffle: repeated rows repeat, an empty
    table gives an empty one, all columns of `images` stay (those four names are replaced if present).
    """
    machine = Automaton([Rule(*r) for r in rules])
    host, inside = host_and_path(F.col(path))
    split = images.withColumns({"host": host, "path_in_host": inside})
    schema = StructType([StructField("rule", StringType()), StructField("verdict", StringType())])

    @F.pandas_udf(schema)
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = machine.match([(h + p).encode() for h, p in zip(hosts, paths)])
            yield pd.DataFrame({"rule": [machine.rules[i].text if i >= 0 else None for i in found],
                                "verdict": [machine.rules[i].verdict if i >= 0 else default for i in found]})

    (found,) = own_name(split, "_judged")
    judged = split.withColumn(found, judge("host", "path_in_host"))
    return judged.withColumns({"rule": F.col(f"{found}.rule"), "verdict": F.col(f"{found}.verdict")}).drop(found)
