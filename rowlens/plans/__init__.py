"""Options and schema comparison, decided on the driver."""
