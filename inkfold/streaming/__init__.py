"""The batch jobs on arriving files. All are stateless: no watermark and no state store."""
