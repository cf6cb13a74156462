"""Beyond the operators proper: sums that a stream keeps up to date."""
