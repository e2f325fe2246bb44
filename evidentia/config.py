"""Constants that define the semantics of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Funnel:
    """Depths of the retrieval funnel: papers k -> n, chunks c_wide -> c_top."""

    k: int = 200
    n: int = 20
    c_wide: int = 400
    c_top: int = 100

    def __post_init__(self) -> None:
        if self.c_wide < self.c_top:
            raise ValueError("the wide chunk depth is at least the final one")


PAPER_CHUNK_LIMIT = 8
TARGET_CATEGORY = "cs.AI"
ID_YEARS = tuple(f"{y:02d}" for y in range(15, 27))
UUID_NAMESPACE = "6f9619ff-8b86-d011-b42d-00c04fc964ff"
CHUNK_TOKENS = 512
MIN_TRIPLE_SCORE = 0.5
GAZETTEER_CONFIDENCE = 0.9
VERIFY_BUDGET, VERIFY_MARGIN, VERIFY_HIGH, VERIFY_LOW = 40, 0.05, 0.7, 0.4
TOP_ENTITIES = 20
SQL_ROW_CAP = 1000
GATE_AGGREGATE, GATE_CLAIM = 0.5, 0.7
CREDIT_FEE = 1.055
HEARTBEAT_STALE_S = 300
MAX_ITERATIONS, MAX_TOKENS, MAX_COST_USD, MAX_BACKTRACKS = 10, 382_025, 0.50, 3
EVIDENCE_CHUNKS, EVIDENCE_CHUNK_CHARS, EVIDENCE_TOTAL_CHARS = 64, 2_000, 120_000
LOOKUP_IDS, LOOKUP_CHARS, LOOKUP_CHUNKS, PREVIEW_CHARS = 50, 4_000, 500, 160
RRF_K = 60


def hnsw_ef_for(limit: int) -> int:
    """Over-fetch of an approximate search that is to return ``limit`` rows."""
    return min(1000, max(400, 4 * limit))
