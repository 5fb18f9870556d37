"""What can go wrong, by part. Each kind is also the built-in error that callers may expect."""


class CorpusError(Exception):
    """Base of all errors of this package."""


class InvalidDocument(CorpusError, ValueError):
    """A document table that does not meet the schema."""


class MissingReport(CorpusError, FileNotFoundError):
    """A report that is to be judged is not there."""


class UnknownVersion(CorpusError, ValueError):
    """A version of the knowledge base that was never saved."""


class CommitConflict(CorpusError, RuntimeError):
    """Another writer committed first."""


class RetrievalError(CorpusError, RuntimeError):
    """Retrieval, dense or lexical or their fusion, that cannot be done."""


class RerankerError(RetrievalError):
    """A reranker that fails or gives scores that are none."""


class EvidenceError(CorpusError, ValueError):
    """Evidence or contexts that cannot be made of the hits."""


class EvaluationError(CorpusError, ValueError):
    """An evaluation without what it needs: an empty evaluation set, floors for measures that are not there."""


class SettingsError(CorpusError, ValueError):
    """A setting that is missing or of the wrong kind."""


class BackendUnavailable(CorpusError, ValueError):
    """A generator that was asked for by name cannot be used."""
