"""Options of the scoring jobs. Plain values, passed by the caller; no global state."""

from __future__ import annotations

from dataclasses import dataclass, field

# Certificate field names and their weights in the overall accuracy.
FIELD_LEVEL = "障礙等級"
FIELD_CATEGORY = "障礙類別"
FIELD_ICD = "ICD診斷"
FIELD_CERTIFICATE = "證明/手冊"
DEFAULT_WEIGHTS = {
    FIELD_LEVEL: 0.3,
    FIELD_CATEGORY: 0.3,
    FIELD_ICD: 0.25,
    FIELD_CERTIFICATE: 0.15,
}
FALLBACK_WEIGHT = 0.25

# Default truth and prediction columns of a headed certificate table.
DEFAULT_MAPPING = {
    FIELD_LEVEL: ("正面_障礙等級", "反面_障礙等級"),
    FIELD_CATEGORY: ("正面_障礙類別", "反面_障礙類別"),
    FIELD_ICD: ("正面_ICD診斷", "反面_ICD診斷"),
}

# Default prediction and truth columns of a headed document table.
DEFAULT_DOCUMENT_MAPPING = {
    "發文日期": ("gemma 3 27b qat", "Unnamed: 5"),
    "得請領_金額": ("Chatgpt 4.1", "Unnamed: 8"),
    "繼續性_金額": ("Chatgpt 4.1.1", "Unnamed: 11"),
    "解約金_金額": ("Chatgpt 4.1.2", "Unnamed: 14"),
    "解約金_範圍": ("Chatgpt 4.1.3", "Unnamed: 17"),
    "小額終老非扣押範圍": ("Chatgpt 4.1.4", "Unnamed: 20"),
}

METHODS = ("edit", "gestalt", "gestalt_trim", "opcode")
DENOMINATORS = ("max", "reference")
EDIT_ENGINES = ("builtin", "auto")


@dataclass(frozen=True)
class ScoringConfig:
    """How pairs are compared and how work is spread.

    ``method``       edit distance (default) or one of the documented variants.
    ``denominator``  longer length (default) or reference length.
    ``edit_engine``  ``builtin`` keeps every pair inside JVM code generation. ``auto`` also does so
                     for short pairs but sends pairs whose length product exceeds
                     ``long_pair_cells`` to an Arrow helper, which is about 100 times faster there.
    ``chunk_rows``   rows per chunk of the prefix scans over one sheet.
    ``hot_splits``   into how many slices a join spreads the rows of one workbook.
    ``max_starts``   model-naming rows of one workbook that are searched as an array per row.
    """

    exact_threshold: float = 0.99
    mismatch_threshold: float = 0.8
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    fallback_weight: float = FALLBACK_WEIGHT
    method: str = "edit"
    denominator: str = "max"
    edit_engine: str = "builtin"
    long_pair_cells: int = 250_000
    chunk_rows: int = 100_000
    hot_splits: int = 16
    max_starts: int = 256

    def __post_init__(self) -> None:
        for name in ("exact_threshold", "mismatch_threshold"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if self.denominator not in DENOMINATORS:
            raise ValueError(f"denominator must be one of {DENOMINATORS}")
        if self.edit_engine not in EDIT_ENGINES:
            raise ValueError(f"edit_engine must be one of {EDIT_ENGINES}")
        if min(self.chunk_rows, self.hot_splits, self.max_starts) < 1:
            raise ValueError("chunk_rows, hot_splits and max_starts must be positive")
