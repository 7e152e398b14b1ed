"""Errors raised by the engine; every message names the offending argument."""


class IonweaveError(ValueError):
    """Base class."""


class ConfigError(IonweaveError):
    pass


class SourceError(IonweaveError):
    pass


class PreprocessError(IonweaveError):
    pass


class RegionError(IonweaveError):
    pass


class RegistrationError(IonweaveError):
    pass


class QuantifyError(IonweaveError):
    pass


class AnalysisError(IonweaveError):
    pass


class StageError(IonweaveError):
    pass
