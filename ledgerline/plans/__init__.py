"""Plan-time decisions and the composite jobs built from the operators."""
