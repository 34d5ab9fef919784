"""Error classes raised on the driver."""


class BatchError(Exception):
    """Base class of every error raised by this package."""


class SchemaNotFound(BatchError):
    """No schema of that name is registered."""


class SchemaValidation(BatchError):
    """A schema definition, or the binding of a batch to it, is not usable."""


class RecordNotFound(BatchError):
    """A lookup that must find a record found none."""


class DatasetNotFound(BatchError):
    """There is no dataset at the given path."""


class ReadFailed(BatchError):
    """The dataset exists but cannot be read."""


class InvalidData(BatchError):
    """The data does not conform to the schema or cannot be decoded."""


class EmptyInput(InvalidData):
    """The batch or payload holds nothing."""


class KeyConflict(InvalidData):
    """Primary-key rules are broken inside the batch or against the target."""
