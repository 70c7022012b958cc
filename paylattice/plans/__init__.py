"""Physical patterns: joins safe under hot keys, global order, blocked nearest neighbours."""
