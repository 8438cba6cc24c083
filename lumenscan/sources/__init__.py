"""Sources and sinks: scan files, spectra tables, parameter documents, exports."""
