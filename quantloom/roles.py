"""Which column of an input plays which part, with profiles of common exports."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Filters:
    """Conjunctive filters, applied in this order: equal, not equal, less, greater."""

    equal: dict[str, str] = field(default_factory=dict)
    not_equal: dict[str, str] = field(default_factory=dict)
    less: dict[str, float] = field(default_factory=dict)
    greater: dict[str, float] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [*self.equal, *self.not_equal, *self.less, *self.greater]


@dataclass(frozen=True)
class Roles:
    sample: str
    primary: str
    secondary: tuple[str, ...]
    intensity: str
    annotation: tuple[str, ...] = ()
    separator: str | None = None
    fragment_ids: str | None = None
    na_string: str = "0"
    filters: Filters = field(default_factory=Filters)

    def columns(self) -> list[str]:
        """All columns that must be there, each once."""
        own = [self.sample, self.primary, *self.secondary, self.intensity, *self.annotation, *([self.fragment_ids] if self.fragment_ids else []), *self.filters.columns()]
        return list(dict.fromkeys(own))

    def but(self, **changes) -> Roles:
        return replace(self, **changes)


# Column names and limits of the export formats.
SPECTRONAUT = Roles(
    sample="R.Condition", primary="PG.ProteinGroups", secondary=("EG.ModifiedSequence", "FG.Charge", "F.FrgIon", "F.Charge"), intensity="F.PeakArea",
    annotation=("PG.Genes", "PG.ProteinNames"), filters=Filters(equal={"F.ExcludedFromQuantification": "False"}, less={"PG.Qvalue": 0.01, "EG.Qvalue": 0.01}),
)
DIANN = Roles(
    sample="File.Name", primary="Protein.Group", secondary=("Precursor.Id",), intensity="Fragment.Quant.Corrected", separator=";",
    filters=Filters(less={"Q.Value": 0.01, "PG.Q.Value": 0.01}),
)
DIANN_PARQUET = Roles(sample="Run", primary="Protein.Group", secondary=("Precursor.Id",), intensity="Intensities", separator=";")
OPENSWATH = Roles(sample="short_name", primary="ProteinName", secondary=("FullPeptideName", "Charge", "aggr_Fragment_Annotation"), intensity="quant")
PROFILES = {"spectronaut": SPECTRONAUT, "diann": DIANN, "diann_parquet": DIANN_PARQUET, "openswath": OPENSWATH}
