"""All registered queries."""
