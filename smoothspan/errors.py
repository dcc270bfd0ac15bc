"""Error hierarchy: everything a user can cause derives from SmoothspanError."""


class SmoothspanError(Exception):
    pass


class ConfigurationError(SmoothspanError):
    pass


class DataValidationError(SmoothspanError):
    pass


class CheckpointError(SmoothspanError):
    pass
