class PivotError(ValueError):
    """A pivot, drill-down or delete that cannot be computed."""


class DefinitionError(PivotError):
    """A pivot definition that breaks a rule; ``findings`` lists every broken rule."""

    def __init__(self, findings):
        self.findings = list(findings)
        super().__init__("; ".join(f.message for f in self.findings))
