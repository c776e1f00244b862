"""Bronze followed as a stream."""
