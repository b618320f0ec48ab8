"""Configuration of a pipeline run."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

ORDER = (
    "input_validation",
    "data_extraction",
    "workspace_object",
    "embedding_generation",
    "family_assignment",
    "similarity_search",
    "sequence_analysis",
    "structure_analysis",
    "network_analysis",
    "bioinformatics_analysis",
    "multi_protein_analysis",
    "report_generation",
    "visualization",
    "data_export",
)


@dataclass
class PipelineConfig:
    """What to run and how; inputs are checked when a pipeline runs, not when the config is made."""

    input_type: str = "FASTA"
    input_data: object = None
    stages: tuple[str, ...] = ("input_validation", "data_extraction", "embedding_generation", "family_assignment", "similarity_search", "sequence_analysis", "network_analysis")
    stop_after_stage: str | None = None
    similarity_threshold: float = 0.1
    top_k: int = 50
    max_similar: int = 100
    neighbours: int = 8
    min_confidence: float | None = None
    network_method: str = "mutual_knn"
    max_proteins: int | None = None
    max_input_size: int | None = 1000
    workspace_client: object = None
    output_dir: str | None = None
    stage_config: dict = field(default_factory=dict)

    def check(self) -> None:
        if self.input_data is None:
            raise ValueError("a run needs input data")
        if not 0 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold must be between 0 and 1")
        if self.max_similar <= 0 or self.top_k <= 0:
            raise ValueError("max_similar and top_k must be positive")
        if unknown := set(self.stages) - set(ORDER):
            raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> PipelineConfig:
        return cls(**values)
