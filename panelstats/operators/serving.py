"""A model that scores raw assessments: repair, profile, class join and booster as persistable
pipeline stages (S4).

``PipelineModel(stages=[...]).write().save(path)`` keeps the whole way from the sheet's text cells to
the score; ``PipelineModel.load(path)`` scores raw rows with it.  Every stage is a thin transformer
over the operator of the same name, so the plans are those of the operators.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from panelstats.operators import boosting
from panelstats.operators.joins import join_label
from panelstats.operators.profile import profile
from panelstats.sources.scan import read_table, typed_scores


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    def _get(self, name: str):
        return self.getOrDefault(getattr(self, name))


class ScoreRepair(_Stage):
    """Score cells to numbers; with ``repairDates`` a cell that is a date is read as day.month."""

    scoreCols = Param(Params._dummy(), "scoreCols", "score columns", TypeConverters.toListString)
    repairDates = Param(Params._dummy(), "repairDates", "rebuild scores from dates", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, scoreCols=None, repairDates=True):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return typed_scores(df, self._get("scoreCols"), self._get("repairDates"))


class PointProfile(_Stage):
    """Raters collapsed to one row of statistics per point (A1-A4)."""

    keyCols = Param(Params._dummy(), "keyCols", "columns that name a point", TypeConverters.toListString)
    scoreCols = Param(Params._dummy(), "scoreCols", "score columns", TypeConverters.toListString)
    stats = Param(Params._dummy(), "stats", "statistics of every score", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, keyCols=None, scoreCols=None, stats=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return profile(df, self._get("keyCols"), self._get("scoreCols"), self._get("stats"))


class ClassJoin(_Stage):
    """The class columns of a stored class table joined to the points."""

    path = Param(Params._dummy(), "path", "stored class table (Parquet)", TypeConverters.toString)
    keyCols = Param(Params._dummy(), "keyCols", "columns that name a point", TypeConverters.toListString)
    classCols = Param(Params._dummy(), "classCols", "columns to join", TypeConverters.toListString)
    how = Param(Params._dummy(), "how", "inner or left", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, path=None, keyCols=None, classCols=None, how="left"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        classes = read_table(df.sparkSession, self._get("path"))
        return join_label(df, classes, self._get("keyCols"), self._get("classCols"), self._get("how"))


class _BoosterWriter(MLWriter):
    def __init__(self, stage: "BoostedScorer"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        boosting.save(self.stage.model, f"{path}/model", self.sparkSession)


class _BoosterReader(MLReader):
    def load(self, path: str) -> "BoostedScorer":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = BoostedScorer(boosting.load(self.sparkSession, f"{path}/model"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class BoostedScorer(Transformer, MLWritable, MLReadable):
    """``keepCols`` with the booster's prediction and probability (M12); saved with its trees."""

    keepCols = Param(Params._dummy(), "keepCols", "columns to keep", TypeConverters.toListString)

    def __init__(self, model: boosting.BoostedModel, keepCols: list[str] | None = None):
        super().__init__()
        self.model = model
        if keepCols is not None:
            self._set(keepCols=keepCols)

    def _transform(self, df: DataFrame) -> DataFrame:
        return boosting.score(self.model, df, self.getOrDefault(self.keepCols))

    def write(self) -> _BoosterWriter:
        return _BoosterWriter(self)

    @classmethod
    def read(cls) -> _BoosterReader:
        return _BoosterReader()
