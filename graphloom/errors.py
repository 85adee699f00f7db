"""Errors by the step that raises them."""


class GraphError(Exception):
    """Any error of this engine."""


class ParseError(GraphError):
    """The text is no statement of the language."""


class BindError(GraphError):
    """Names, types or clauses don't fit together."""


class CatalogError(BindError):
    """A catalogue entry is missing, there already, or in use."""


class RunError(GraphError):
    """Data break a rule while a statement runs."""
