"""ML-7: scaler, reducers and the GP as ``pyspark.ml`` Estimators / Models.

They compose in a ``Pipeline`` and are saved and loaded like Spark's own stages, alone or in a saved
pipeline: parameters as metadata, the fitted state as a Parquet table beside it.
``inverse_transform`` is offered where the method has one and raises ``NotImplementedError``
otherwise.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from surrogata.operators import kpca as kpca_ops
from surrogata.operators import pca as pca_ops
from surrogata.operators import scale as scale_ops
from surrogata.operators import sgp
from surrogata.operators.state import load_state, save_state


class _Writer(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        if self.instance.model is None:
            raise ValueError("only a fitted model can be saved")
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        save_state(self.sparkSession, self.instance.model, f"{path}/state")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = self.cls(load_state(self.sparkSession, f"{path}/state", self.cls.STATE))
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        return made


class _Stored(MLWritable, MLReadable):
    """Save and load of a model whose fitted state is the dataclass ``STATE`` in ``model``."""

    STATE: type

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _VectorModel(Model, HasInputCol, HasOutputCol, _Stored):
    ops = None

    def __init__(self, model=None):
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = [c for c in dataset.columns if c != self.getOutputCol()]
        return self.ops.transform(dataset, self.model, self.getInputCol(), self.getOutputCol(), keep=keep)

    def inverse_transform(self, dataset: DataFrame, outputCol: str = "x_hat") -> DataFrame:
        keep = [c for c in dataset.columns if c != self.getOutputCol()]
        return self.ops.inverse_transform(dataset, self.model, self.getOutputCol(), outputCol, keep=keep)


class _VectorEstimator(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    def _made(self, model):
        model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        return model


class SurrogateScaler(_VectorEstimator):
    """Column-wise standardisation of an ``ARRAY<DOUBLE>`` column (population standard deviation)."""

    def __init__(self, inputCol: str = "x", outputCol: str = "z"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> "SurrogateScalerModel":
        return self._made(SurrogateScalerModel(scale_ops.fit_scaler(dataset, self.getInputCol())))


class SurrogateScalerModel(_VectorModel):
    STATE = scale_ops.Scaler

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return pca_ops._map_vectors(dataset, self.getInputCol(), self.getOutputCol(),
                                    lambda X, s=self.model: (X - s.mean) / s.scale,
                                    keep=[c for c in dataset.columns if c != self.getOutputCol()])

    def inverse_transform(self, dataset: DataFrame, outputCol: str = "x_hat") -> DataFrame:
        return pca_ops._map_vectors(dataset, self.getOutputCol(), outputCol,
                                    lambda Z, s=self.model: Z * s.scale + s.mean,
                                    keep=[c for c in dataset.columns if c != self.getOutputCol()])


class SurrogatePCA(_VectorEstimator):
    """Linear PCA on an ``ARRAY<DOUBLE>`` column: int count or float share (counted on standardised data)."""

    nComponents = Param(Params._dummy(), "nComponents", "int count or float share in (0, 1)")

    def __init__(self, inputCol: str = "x", outputCol: str = "z", nComponents=0.95):
        super().__init__()
        pca_ops.check_n_components(nComponents)
        self._set(inputCol=inputCol, outputCol=outputCol)
        self._set(nComponents=nComponents)

    def _fit(self, dataset: DataFrame) -> "SurrogatePCAModel":
        return self._made(SurrogatePCAModel(
            pca_ops.fit_pca(dataset, self.getInputCol(), self.getOrDefault(self.nComponents))))


class SurrogatePCAModel(_VectorModel):
    STATE = pca_ops.PCAModel
    ops = pca_ops


class SurrogateKernelPCA(_VectorEstimator):
    """Kernel PCA on landmarks with a ridge pre-image."""

    nComponents = Param(Params._dummy(), "nComponents", "count", typeConverter=TypeConverters.toInt)
    kernel = Param(Params._dummy(), "kernel", "linear | poly | rbf | sigmoid | cosine",
                   typeConverter=TypeConverters.toString)
    landmarks = Param(Params._dummy(), "landmarks", "number of landmarks", typeConverter=TypeConverters.toInt)

    def __init__(self, inputCol: str = "x", outputCol: str = "z", nComponents: int = 2, kernel: str = "rbf",
                 landmarks: int = 256):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, nComponents=nComponents, kernel=kernel,
                  landmarks=landmarks)

    def _fit(self, dataset: DataFrame) -> "SurrogateKernelPCAModel":
        return self._made(SurrogateKernelPCAModel(kpca_ops.fit_kpca(
            dataset, self.getInputCol(), self.getOrDefault(self.nComponents), self.getOrDefault(self.kernel),
            m=self.getOrDefault(self.landmarks))))


class SurrogateKernelPCAModel(_VectorModel):
    STATE = kpca_ops.KPCAModel
    ops = kpca_ops


class SurrogateGP(Estimator, HasInputCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Inducing-point GP regression; predictions add mean, sd, lower and upper columns."""

    inducing = Param(Params._dummy(), "inducing", "all (exact) | landmarks | kmeans",
                     typeConverter=TypeConverters.toString)
    maxInducing = Param(Params._dummy(), "maxInducing", "number of inducing points (sparse modes)",
                        typeConverter=TypeConverters.toInt)

    def __init__(self, inputCol: str = "x", labelCol: str = "y", inducing: str = "landmarks", maxInducing: int = 512):
        super().__init__()
        self._set(inputCol=inputCol, labelCol=labelCol, inducing=inducing, maxInducing=maxInducing)

    def _fit(self, dataset: DataFrame) -> "SurrogateGPModel":
        cfg = sgp.GPConfig(inducing=self.getOrDefault(self.inducing),
                           max_inducing=self.getOrDefault(self.maxInducing))
        st = sgp.fit(dataset, self.getInputCol(), self.getOrDefault(self.labelCol), cfg)
        m = SurrogateGPModel(st, cfg.z)
        m._set(inputCol=self.getInputCol())
        return m


class SurrogateGPModel(Model, HasInputCol, _Stored):
    STATE = sgp.GPState
    width = Param(Params._dummy(), "width", "standard deviations from the mean to lower and upper",
                  typeConverter=TypeConverters.toFloat)

    def __init__(self, state: sgp.GPState | None = None, z: float = 2.0):
        super().__init__()
        self.model = state
        self._set(width=z)

    @property
    def state(self) -> sgp.GPState | None:
        return self.model

    @property
    def z(self) -> float:
        return self.getOrDefault(self.width)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return sgp.predict(dataset, self.model, self.getInputCol(), z=self.z)

    def inverse_transform(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError("a regression model has no inverse transform")
