"""An ordered, immutable list of cleaning steps that turns a raw table into a cleaned one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubwell.functions.storage import cut_lineage
from scrubwell.operators import duplicates, missing, outliers, resample, skew, target as targets, text, timestamps

INVERSES: dict[str, Callable[[Column], Column]] = {
    "log": F.expm1,
    "sqrt": lambda c: c * c,
    "cbrt": lambda c: c * c * c,
}


@dataclass(frozen=True)
class Step:
    """A named step with its options; ``train_only`` keeps it off the rows a model is tested on."""

    name: str
    options: tuple[tuple[str, object], ...] = ()
    train_only: bool = False

    def settings(self) -> dict[str, object]:
        return dict(self.options)


@dataclass(frozen=True)
class Cleaned:
    """The cleaned table and what the data decided on the way: per step, the columns it transformed."""

    table: DataFrame
    transforms: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def inverse_of(self, column: str) -> Callable[[Column], Column] | None:
        """The function that undoes all transforms of ``column``; ``None`` if there were none."""
        methods = [m for m, names in self.transforms if column in names]
        if not methods:
            return None

        def undo(value: Column) -> Column:
            for method in reversed(methods):
                value = INVERSES[method](value)
            return value

        return undo


@dataclass(frozen=True)
class CleaningPlan:
    """Steps applied one after another. Every method returns a new plan; the input table is never changed.

    >>> plan = CleaningPlan("price").handle_missing("median").drop_duplicates().fix_skew("log")
    >>> cleaned = plan.apply(raw)
    """

    target: str
    steps: tuple[Step, ...] = field(default=())

    def _then(self, name: str, train_only: bool = False, **options) -> CleaningPlan:
        frozen = tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in options.items())
        return CleaningPlan(self.target, self.steps + (Step(name, frozen, train_only),))

    def index_target(self) -> CleaningPlan:
        return self._then("index_target")

    def handle_missing(self, strategy: str, **options) -> CleaningPlan:
        if strategy not in missing.STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}, expected one of {', '.join(missing.STRATEGIES)}")
        return self._then("handle_missing", strategy=strategy, **options)

    def drop_duplicates(self) -> CleaningPlan:
        return self._then("drop_duplicates")

    def remove_outliers(self, **options) -> CleaningPlan:
        return self._then("remove_outliers", **options)

    def fix_skew(self, method: str = "log", threshold: float = 1.0, include_target: bool = True) -> CleaningPlan:
        if method not in skew.TRANSFORMS:
            raise ValueError(f"unknown method {method!r}, expected one of: {', '.join(skew.TRANSFORMS)}")
        return self._then("fix_skew", method=method, threshold=threshold, include_target=include_target)

    def clean_text(self, columns: Sequence[str]) -> CleaningPlan:
        return self._then("clean_text", columns=tuple(columns))

    def resample(self, method: str, train_only: bool = False, seed: int = resample.SEED) -> CleaningPlan:
        if method not in ("over", "under"):
            raise ValueError(f"unknown method {method!r}, expected 'over' or 'under'")
        return self._then("resample", train_only, method=method, seed=seed)

    def timestamp_features(self) -> CleaningPlan:
        return self._then("timestamp_features")

    def materialize(self) -> CleaningPlan:
        """Write the rows so far to the shared folder, so that later steps do not compute the earlier ones again."""
        return self._then("materialize")

    def reset(self) -> CleaningPlan:
        """The plan without steps: applied, it gives back the raw table."""
        return CleaningPlan(self.target)

    def before_split(self) -> CleaningPlan:
        return CleaningPlan(self.target, tuple(s for s in self.steps if not s.train_only))

    def for_training(self) -> CleaningPlan | None:
        steps = tuple(s for s in self.steps if s.train_only)
        return CleaningPlan(self.target, steps) if steps else None

    def apply(self, df: DataFrame) -> DataFrame:
        return self.run(df).table

    def run(self, df: DataFrame) -> Cleaned:
        """Apply the steps. Steps that need figures of the data run a job for them; the rows stay lazy."""
        transforms = []
        for step in self.steps:
            options = step.settings()
            if step.name == "fix_skew":
                df, names = skew.fix_skew(df, target=self.target, **options)
                transforms.append((options["method"], tuple(names)))
            else:
                df = _ACTIONS[step.name](df, self.target, **options)
        return Cleaned(df, tuple(transforms))


_ACTIONS: dict[str, Callable[..., DataFrame]] = {
    "index_target": targets.index_target,
    "handle_missing": lambda df, target, **o: missing.handle_missing(df, **o),
    "drop_duplicates": duplicates.drop_duplicates,
    "remove_outliers": outliers.remove_outliers,
    "clean_text": lambda df, target, columns: text.clean_text_columns(df, list(columns)),
    "resample": resample.resample,
    "timestamp_features": lambda df, target: timestamps.timestamp_features(df),
    "materialize": lambda df, target: cut_lineage(df),
}
