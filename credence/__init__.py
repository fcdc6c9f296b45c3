"""Label, feature and evaluation analytics for generated code, as DataFrame operators."""
